"""As-of ties and tolerances, overlaps, search ahead, resampling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, bars_of, times
from quotelake.operators import asof, blocks, evidence, quality, resample, segments


def frame(spark, rows, schema):
    return spark.createDataFrame([(k, at(t), *v) for k, t, *v in rows], schema)


def test_ties_strict_and_null_fields(spark):
    left = frame(spark, [("A", "2024-01-01 10:00"), ("A", "2024-01-01 09:59")], "k string, t timestamp")
    right = frame(spark, [("A", "2024-01-01 09:00", 1.0), ("A", "2024-01-01 10:00", None)], "k string, at timestamp, v double")
    get = lambda **kw: {r.t.strftime("%H:%M"): (r.at, r.v) for r in asof.asof(left, right, ["k"], "t", "at", ["at", "v"], **kw).collect()}
    inclusive = get()
    assert inclusive["10:00"] == (at("2024-01-01 10:00"), None)  # the row is taken whole
    assert get(strict=True)["10:00"][1] == 1.0
    assert get(tolerance_seconds=3000)["09:59"] == (None, None)
    assert get(forward=True)["09:59"][0].hour == 10


@pytest.mark.parametrize("forward", [False, True])
def test_asof_equals_pandas_over_small_blocks(spark, forward):
    rng = np.random.default_rng(3)
    t = lambda n: pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4000, n) * 7, unit="s")
    left = pd.DataFrame({"k": rng.choice(["H", "B"], 300, p=[0.9, 0.1]), "t": t(300), "i": range(300)}).sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["H", "B"], 200, p=[0.9, 0.1]), "at": t(200), "v": rng.random(200)}).drop_duplicates(["k", "at"]).sort_values("at")
    want = pd.merge_asof(left, right, left_on="t", right_on="at", by="k", direction="forward" if forward else "backward").sort_values("i")
    got = asof.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "at", ["v"], forward=forward, block_rows=16).toPandas().sort_values("i")
    np.testing.assert_allclose(got.v.astype(float), want.v)


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 500, n), rng.integers(0, 60, n))]
    req, taken = make(40), make(120)
    ts = lambda x: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=x)).to_pydatetime()
    a = spark.createDataFrame([(i, ts(s), ts(e)) for i, (s, e) in enumerate(req)], "id long, start timestamp, end timestamp")
    b = spark.createDataFrame([(ts(s), ts(e)) for s, e in taken], "start timestamp, end timestamp")
    got = {r.id: r.overlaps for r in asof.count_overlaps(a, b, block_rows=8).collect()}
    assert got == {i: sum(s2 <= e and e2 >= s for s2, e2 in taken) for i, (s, e) in enumerate(req)}


@pytest.mark.parametrize("bucket", [4, 50])
def test_first_touch_equals_brute_force(spark, bucket):
    rng = np.random.default_rng(9)
    v = 100 + rng.normal(0, 1, 200).cumsum()
    series = spark.createDataFrame([("X", i, float(p)) for i, p in enumerate(v)], "k string, rn long, v double")
    e = [(i, i + int(rng.integers(0, 40)), v[i] - 2, v[i] + 3) for i in range(0, 200, 3)]
    entries = spark.createDataFrame([("X", a, b, float(lo), float(hi)) for a, b, lo, hi in e], "k string, `from` long, `to` long, lower double, upper double")
    got = {r["from"]: r["at"] for r in asof.first_touch(entries, series, ["k"], low="v", high="v", bucket=bucket, span=40).collect()}
    want = {}
    for a, b, lo, hi in e:
        hits = [j for j in range(a + 1, min(b, 199) + 1) if v[j] <= lo or v[j] >= hi]
        if hits:
            want[a] = hits[0]
    assert got == want


def test_a_far_horizon_costs_few_rows(spark):
    """A range of a million rows is a logarithmic number of nodes, and the touch at its end is found."""
    one = spark.createDataFrame([(5, 1_000_003)], "a long, z long")
    parts = one.select(F.explode(asof.covering(F.col("a"), F.col("z"), 16, 4)).alias("n")).select("n.*").collect()
    spans = sorted((r._node * 16**r._level, (r._node + 1) * 16**r._level) for r in parts)
    assert len(parts) <= 5 * 30 and spans[0][0] == 5 and spans[-1][1] == 1_000_003 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    series = spark.range(1_000_000).select(F.lit("X").alias("k"), F.col("id").alias("rn"), F.when(F.col("id") == 999_990, 5.0).otherwise(1.0).alias("v"))
    entries = spark.createDataFrame([("X", i, i + 1_000_000, None, 4.0) for i in (0, 17, 999_989, 999_990)], "k string, `from` long, `to` long, lower double, upper double")
    got = {r["from"]: r["at"] for r in asof.first_touch(entries, series, ["k"], low="v", high="v", span=1_000_000).collect()}
    assert got == {0: 999_990, 17: 999_990, 999_989: 999_990}
    with pytest.raises(Exception, match="further ahead"):
        asof.first_touch(entries, series, ["k"], low="v", high="v", span=50).collect()


def test_covering_nodes_are_exact(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)]
    df = spark.createDataFrame(rows, "a long, z long")
    for r in df.select("a", "z", asof.covering(F.col("a"), F.col("z"), 3, 3).alias("n")).collect():
        covered = sorted(p for n in r.n for p in range(n._node * 3**n._level, (n._node + 1) * 3**n._level))
        assert covered == list(range(r.a, r.z)) and len(r.n) <= 3 * 4 + 6


def test_open_intervals_touch_what_comes_later(spark):
    t = lambda h: None if h is None else at(f"2024-01-01 {h:02d}:00:00")
    taken = spark.createDataFrame([(t(4), t(None)), (t(None), t(2))], "start timestamp, end timestamp")
    requests = spark.createDataFrame([(1, t(5), t(7)), (2, t(5), None), (3, None, t(1)), (4, None, None), (5, t(3), t(3))], "id long, start timestamp, end timestamp")
    assert {r.id: r.overlaps for r in asof.count_overlaps(requests, taken).collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0}


def test_rollup_drops_a_bucket_with_a_missing_part(spark):
    b = bars_of(spark, [float(i) for i in range(1, 16)], "1min").filter("close <> 3")
    out = resample.rollup_complete(b.select("asset", "ts", "open", "high", "low", "close"), 60, 300).orderBy("ts").collect()
    assert [(r.ts.minute, r.open, r.close) for r in out] == [(5, 6.0, 10.0), (10, 11.0, 15.0)]


def test_schedule_puts_a_decision_on_its_last_bar(spark):
    b = bars_of(spark, [float(i) for i in range(1, 11)], "1min").drop("entry")
    coarse = resample.rollup_complete(b, 60, 300)
    d = coarse.select("asset", "ts", F.lit(True).alias("entry"), F.lit(False).alias("exit"), F.col("close").alias("signal_price"))
    out = resample.schedule(b, d, 60, 300).orderBy("ts").collect()
    assert [i for i, r in enumerate(out) if r.decision] == [4, 9]
    assert out[0].signal_price is None and out[4].signal_price == 5.0


def test_first_partial_bucket_is_no_bar(spark):
    q = spark.createDataFrame([("X", at(t), i, 1.0, 2.0) for i, t in enumerate(["2024-01-01 00:00:30", "2024-01-01 00:01:00", "2024-01-01 00:02:00"])],
                              "asset string, ts timestamp, sequence long, bid double, ask double")
    assert [r.ts.minute for r in resample.signal_bars(q, 60).orderBy("ts").collect()] == [1, 2]


def test_weekend_rule_and_inverse(spark):
    hours = {"2024-01-05 22:00": False, "2024-01-05 23:00": True, "2024-01-06 12:00": True, "2024-01-07 19:00": True, "2024-01-07 20:00": False}
    df = spark.createDataFrame([(at(t),) for t in hours], "t timestamp").orderBy("t")
    assert [r[0] for r in df.select(quality.closed_weekend(F.col("t"))).collect()] == list(hours.values())
    one = spark.createDataFrame([("X", times(1)[0], 2.0, 5.0, 1.0, 4.0)], "asset string, ts timestamp, open double, high double, low double, close double")
    r = resample.invert_ohlc(one).collect()[0]
    assert (r.open, r.close, r.high, r.low) == (0.5, 0.25, 1.0, 0.2)


def test_reconcile_passes_on_equal_and_names_differences(spark):
    a = bars_of(spark, [1.0, 2.0, 3.0])
    assert segments.reconcile(a, a, ["asset", "ts"], ["close"], ["entry"], 1e-8).collect()[0].passed
    b = a.withColumn("close", F.when(F.col("close") == 2, 2.1).otherwise(F.col("close")))
    r = segments.reconcile(a, b, ["asset", "ts"], ["close"], ["entry"], 1e-8).collect()[0]
    assert (r.mismatch_close, r.mismatch_entry, r.passed) == (1, 0, False)


def test_confirmation_needs_bars_and_days(spark):
    b = bars_of(spark, [1.0] * 150)
    end = lambda days: evidence.confirmation_end(b, ["asset"], 86400, 86400, days).collect()[0].end_ts
    assert end(10) == times(150)[119]
    assert end(140) == times(150)[140]
    assert end(150) is None


@pytest.mark.parametrize("slot_bars", [1, 7, 64, 4096])
def test_confirmation_counts_complete_bars_over_slots(spark, slot_bars):
    b = bars_of(spark, [1.0] * 150).where(F.dayofyear("ts") != 9)
    end = lambda need: evidence.confirmation_end(b, ["asset"], 86400, 86400, 1, need, slot_bars).collect()[0].end_ts
    days = [r.ts for r in b.orderBy("ts").collect()]
    assert [end(n) for n in (7, 63, 149, 150)] == [days[6], days[62], days[148], None]


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 18])
def test_grid_is_filled_over_block_edges(spark, block_rows):
    marks = [("A", "2024-01-01 03:00", 1.0), ("A", "2024-01-01 03:30", 2.0), ("A", "2024-01-02 12:00", None), ("A", "2024-01-04 00:00", 3.0),
             (None, "2024-01-03 05:59", 5.0), ("B", "2024-01-09 00:00", 9.0), ("B", "2023-12-31 23:00", 8.0)]
    df = frame(spark, marks, "asset string, ts timestamp, v double")
    got = {(r.asset, r.boundary): r.value for r in resample.grid_sample(df, "v", 3600, "2024-01-01", "2024-01-06", 100.0, block_rows).collect()}
    hours = [at("2024-01-01") + pd.Timedelta(hours=h) for h in range(1, 121)]
    want = {}
    for asset in ("A", None, "B"):
        own = sorted((at(t), v) for a, t, v in marks if a == asset and v is not None and at("2024-01-01") <= at(t) < at("2024-01-06"))
        want |= {(asset, h): ([v for t, v in own if t < h] or [100.0])[-1] for h in hours}
    assert {(a, pd.Timestamp(t)): v for (a, t), v in got.items()} == {(a, pd.Timestamp(t)): v for (a, t), v in want.items()}
    assert resample.grid_sample(df, "v", 3600, "2024-01-01", "2024-01-01", 100.0, block_rows).count() == 0


def test_hour_coverage_marks_closed_saturday(spark):
    q = spark.createDataFrame([("X", at("2024-01-05 10:10"), 0, 1.0, 1.1)], "asset string, ts timestamp, sequence long, bid double, ask double")
    got = {str(r.day): r for r in quality.hour_coverage(q, "2024-01-05", "2024-01-07").collect()}
    assert got["2024-01-06"].closed_hours == 24 and got["2024-01-06"].expected_hours == 0
    assert got["2024-01-05"].expected_hours == 23 and got["2024-01-05"].present_hours == 1


def test_row_ranges_of_folds_do_not_overlap(spark):
    n = spark.createDataFrame([("X", 1000)], "asset string, n long")
    f = evidence.fold_bounds(n, F.lit(400), 3, 20).orderBy("fold").collect()
    assert [(r.test_from, r.test_to) for r in f] == [(400, 600), (600, 800), (800, 1000)]
    assert all(r.train_to == r.test_from - 20 for r in f)
