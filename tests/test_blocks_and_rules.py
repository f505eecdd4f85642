"""Blocks change nothing but the cut; rule functions keep their missing-value rules."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, times
from quotelake.functions import order_stats, signals, ta
from quotelake.operators import blocks, evidence
from quotelake.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(7)
    parts = []
    # One key holds most rows; a stretch of them shares one minute.
    for asset, n in (("HOT", 700), ("B", 60), ("C", 3)):
        gaps = rng.exponential(900, n)
        gaps[n // 3 : n // 3 + 40] = 0.5
        x = 100 + rng.normal(0, 1, n).cumsum()
        x[rng.random(n) < 0.1] = np.nan
        close = 100 + rng.normal(0, 1, n).cumsum()
        parts.append(pd.DataFrame({"asset": asset, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(gaps.cumsum().round(3), unit="s"), "sequence": range(n), "x": x,
                                   "y": rng.integers(0, 4, n).astype(float), "open": close, "high": close + 1, "low": close - 1, "close": close}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_row_number_is_exact_across_blocks(wave):
    pdf, df = wave
    got = blocks.with_row_number(df, ["asset"], ["ts", "sequence"], block_rows=16).toPandas().sort_values(["asset", "ts", "sequence"])
    assert (got.groupby("asset").cumcount() == got.rn).all()
    assert len(got) == len(pdf)


def test_previous_row_crosses_blocks(wave):
    pdf, df = wave
    got = blocks.with_previous(df, ["asset"], ["ts", "sequence"], {"p": "close"}, block_rows=8).toPandas().sort_values(["asset", "ts", "sequence"])
    want = got.groupby("asset").close.shift(1)
    np.testing.assert_allclose(got.p.astype(float), want)


x, y = ta.number("x"), ta.number("y")
CASES = {
    "sma": (ta.sma(x, 5), lambda g: g.x.rolling(5).mean()),
    "std": (ta.std(x, 4), lambda g: g.x.rolling(4).std()),
    "total": (ta.total(x, 3), lambda g: g.x.rolling(3).sum()),
    "lowest": (ta.lowest(x, 6), lambda g: g.x.rolling(6).min()),
    "highest": (ta.highest(x, 6), lambda g: g.x.rolling(6).max()),
    "lag": (ta.lag(x, 7), lambda g: g.x.shift(7)),
    "change": (ta.change(x, 2), lambda g: g.x - g.x.shift(2)),
    "pct": (ta.pct(x, 3), lambda g: g.x / g.x.shift(3) - 1),
    "rank": (ta.rank(y, 5), lambda g: g.y.rolling(5, min_periods=5).rank(pct=True)),
    "quantile": (ta.quantile(x, 5, 0.3), lambda g: g.x.rolling(5, min_periods=5).quantile(0.3)),
    "ema3": (ta.ema(x, 3), lambda g: g.x.ewm(span=3, min_periods=3, adjust=False).mean()),
    "ema20": (ta.ema(x, 20), lambda g: g.x.ewm(span=20, min_periods=20, adjust=False).mean()),
    "ema1": (ta.ema(x, 1), lambda g: g.x.ewm(span=1, min_periods=1, adjust=False).mean()),
    "std1": (ta.std(x, 1), lambda g: g.x * np.nan),
    "nested": (ta.lag(ta.highest(x, 3), 1) - ta.sma(ta.change(x, 1), 2), lambda g: g.x.rolling(3).max().shift(1) - g.x.diff().rolling(2).mean()),
}


@pytest.mark.parametrize("block_rows", [40, 1 << 18])
def test_trailing_functions_match_pandas(wave, block_rows):
    pdf, df = wave
    got = ta.evaluate(df, {n: f for n, (f, _) in CASES.items()}, ["asset"], ["ts", "sequence"], block_rows=block_rows).toPandas()
    got = got.sort_values(["asset", "ts", "sequence"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    for name, (_, want) in CASES.items():
        expect = pd.concat([want(g) for _, g in got.groupby("asset")])
        np.testing.assert_allclose(got[name].astype(float), expect.astype(float), rtol=0, atol=1e-7, err_msg=name)


LONG = {
    "sma": (ta.sma(x, 50), lambda g: g.x.rolling(50).mean()),
    "std": (ta.std(x, 50), lambda g: g.x.rolling(50).std()),
    "total": (ta.total(x, 33), lambda g: g.x.rolling(33).sum()),
    "lowest": (ta.lowest(x, 50), lambda g: g.x.rolling(50).min()),
    "highest": (ta.highest(x, 77), lambda g: g.x.rolling(77).max()),
    "corr": (ta.corr(x, y, 50), lambda g: g.x.rolling(50).corr(g.y)),
    "rank": (ta.rank(y, 50), lambda g: g.y.rolling(50, min_periods=50).rank(pct=True)),
    "rank_x": (ta.rank(x, 61), lambda g: g.x.rolling(61, min_periods=61).rank(pct=True)),
    "quantile": (ta.quantile(x, 50, 0.3), lambda g: g.x.rolling(50).quantile(0.3)),
    "highest_quantile": (ta.quantile(y, 40, 1.0), lambda g: g.y.rolling(40).quantile(1.0)),
    "nested": (ta.sma(ta.rank(ta.change(y, 1), 40), 35), lambda g: g.y.diff().rolling(40).rank(pct=True).rolling(35).mean()),
}


@pytest.mark.parametrize("block_rows", [7, 64, 1 << 18])
def test_long_windows_match_pandas(wave, block_rows):
    pdf, df = wave
    df = df.withColumn("x", F.coalesce("x", F.lit(100.0)))
    pdf = pdf.fillna({"x": 100.0})
    got = ta.evaluate(df, {n: f for n, (f, _) in LONG.items()}, ["asset"], ["ts", "sequence"], block_rows=block_rows).toPandas()
    got = got.sort_values(["asset", "ts", "sequence"]).reset_index(drop=True)
    for name, (_, want) in LONG.items():
        expect = pd.concat([want(g) for _, g in pdf.groupby("asset", sort=True)]).astype(float)
        assert got[name].notna().sum() > 500
        np.testing.assert_allclose(got[name].astype(float), expect, rtol=0, atol=1e-7, err_msg=name)


def test_long_windows_with_missing_and_flat_values(spark):
    v = [1.0] * 60 + [None] + [float(i % 7) for i in range(120)]
    df = spark.createDataFrame([("X", t, a, 0.1) for t, a in zip(times(len(v)), v)], "asset string, ts timestamp, v double, flat double")
    a, flat = ta.number("v"), ta.number("flat")
    got = ta.evaluate(df, {"s": ta.std(a, 40), "m": ta.sma(a, 40), "r": ta.rank(a, 40), "q": ta.quantile(a, 40, 0.25), "f": ta.std(flat, 50), "c": ta.corr(a, flat, 40)}, ["asset"], ["ts"]).toPandas().sort_values("ts").reset_index(drop=True)
    x = pd.Series(v, dtype=float)
    np.testing.assert_allclose(got.s.astype(float), x.rolling(40).std(), atol=1e-9)
    np.testing.assert_allclose(got.m.astype(float), x.rolling(40).mean(), atol=1e-9)
    np.testing.assert_allclose(got.r.astype(float), x.rolling(40).rank(pct=True), atol=1e-12)
    np.testing.assert_allclose(got.q.astype(float), x.rolling(40).quantile(0.25), atol=1e-12)
    assert got.f.dropna().tolist() == [0.0] * (len(v) - 49) and got.c.isna().all() and (got.s[39:60] == 0).all()


def test_long_windows_do_not_cancel(spark):
    """A small wave after values ten orders larger: a difference of running sums would lose it."""
    v = [1e10] * 300 + [math.sin(i) for i in range(900)]
    df = spark.createDataFrame([("X", t, a) for t, a in zip(times(len(v), "1min"), v)], "asset string, ts timestamp, v double")
    a = ta.number("v")
    got = ta.evaluate(df, {"s": ta.std(a, 100), "t": ta.total(a, 100)}, ["asset"], ["ts"]).toPandas().sort_values("ts").reset_index(drop=True)
    for i in (400, 450, 1199):
        w = np.array(v[i - 99 : i + 1])
        np.testing.assert_allclose([got.s[i], got.t[i]], [w.std(ddof=1), w.sum()], rtol=1e-12)


def test_wavelet_matrix_against_sorting():
    r = np.random.default_rng(2)
    values = r.integers(0, 13, 400)
    tree = order_stats.WaveletMatrix(values, 4)
    start = r.integers(0, 380, 200)
    end = start + r.integers(1, 21, 200)
    want = [np.sort(values[a:b]) for a, b in zip(start, end)]
    k = np.array([len(w) // 2 for w in want])
    assert tree.kth(start, end, k).tolist() == [w[i] for w, i in zip(want, k)]
    less, same = tree.below(start, end, np.full(200, 6))
    assert less.tolist() == [(w < 6).sum() for w in want] and same.tolist() == [(w == 6).sum() for w in want]


def test_a_long_rank_over_many_rows_is_quick():
    v = np.random.default_rng(0).normal(size=1 << 18)
    begin = time.process_time()
    rank, _ = order_stats.trailing(v, 5000, [0.5], True)
    assert time.process_time() - begin < 5
    assert rank[9999] == ((v[5000:10000] < v[9999]).sum() + 1) / 5000


def test_correlation_matches_pandas_and_flat_is_missing(wave):
    _, df = wave
    got = ta.evaluate(df.withColumn("one", F.lit(1.0)), {"c": ta.corr(x, y, 6), "flat": ta.corr(x, ta.number("one"), 6)}, ["asset"], ["ts", "sequence"], block_rows=32).toPandas()
    got = got.sort_values(["asset", "ts", "sequence"]).reset_index(drop=True)
    want = pd.concat([g.x.rolling(6).corr(g.y) for _, g in got.groupby("asset")]).replace([np.inf, -np.inf], np.nan)
    both = got.c.notna() & want.notna()
    assert both.sum() > 300
    np.testing.assert_allclose(got.c[both], want[both], atol=1e-9)
    assert got.flat.isna().all()


def test_missing_is_never_true(spark):
    df = spark.createDataFrame([("X", 1, float("nan")), ("X", 2, 2.0), ("X", 3, 0.0)], "asset string, i int, v double")
    v = ta.number("v")
    out = ta.evaluate(df, {"ne": ta.signal(v != 1), "gt": ta.signal(v > 1), "div": 1.0 / v, "log": ta.log(v), "either": ta.signal((v > 1) | ~(v > 1))}, ["asset"], ["i"]).orderBy("i").collect()
    assert [r.ne for r in out] == [False, True, True]
    assert [r.gt for r in out] == [False, True, False]
    assert [r.div for r in out] == [None, 0.5, None]
    assert out[2].log is None and [r.either for r in out] == [False, True, True]


def test_ema_gap_probe(spark):
    df = spark.createDataFrame([("X", t, v) for t, v in zip(times(3), (1.0, None, 4.0))], "asset string, ts timestamp, v double")
    out = ta.evaluate(df, {"e": ta.where(ta.ema(ta.col("v"), 3) > 0, ta.ema(ta.col("v"), 3), 0.0), "n2": ta.ema(ta.col("v"), 2)}, ["asset"], ["ts"]).orderBy("ts").collect()
    assert out[2].e is None  # two values are fewer than the span
    assert abs(out[2].n2 - (1 / 9 * 1 + 2 / 3 * 4) / (1 / 9 + 2 / 3)) < 1e-12


def test_warmup_adds_up():
    assert ta.lag(ta.highest(x, 20), 1).lookback == 20
    assert (ta.sma(ta.change(x, 2), 5) > 0).lookback == 6


def test_bad_windows_are_refused():
    with pytest.raises(ValueError):
        ta.lag(x, 0)
    with pytest.raises(ValueError):
        ta.sma(x, -1)
    with pytest.raises(ValueError):
        ta.quantile(x, 3, 1.5)
    with pytest.raises(ValueError):
        signals.family("nope", 2, 3)


def test_no_family_reads_the_future(wave, spark):
    _, df = wave
    rows = blocks.with_row_number(df, ["asset"], ["ts", "sequence"])
    rules = {f: signals.entry(f, 5, 20, 1.0, "low_volatility" if f == "trend" else "none", "strong_close") for f in signals.FAMILIES}
    out = evidence.causality_audit(rows, lambda d: ta.evaluate(d, rules, ["asset"], ["ts", "sequence"], block_rows=64), ["asset"], ["ts", "sequence"], ["open", "high", "low", "close"], list(rules)).collect()
    assert all(r.passed and r.compared > 300 for r in out)


def test_a_leaking_rule_is_caught(wave):
    _, df = wave
    rows = blocks.with_row_number(df, ["asset"], ["ts", "sequence"])

    def leak(d):
        return evidence.ahead(d, ["asset"], {"next": ("close", 1)}).withColumn("up", F.col("next") > F.col("close"))

    assert not all(r.passed for r in evidence.causality_audit(rows, leak, ["asset"], ["ts", "sequence"], ["close"], ["up"]).collect())


def test_exact_quantiles_with_hot_value(spark):
    v = [1.0] * 500 + list(np.linspace(-3, 9, 101))
    df = spark.createDataFrame([("A", float(i)) for i in v] + [("B", 2.0)], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}, bins=4).collect()}
    np.testing.assert_allclose([got["A"].a, got["A"].b, got["A"].c], np.quantile(v, [0.05, 0.5, 0.99]))
    assert (got["B"].a, got["B"].c) == (2.0, 2.0)


@pytest.mark.parametrize("bins", [2, 4096])
def test_exact_quantiles_of_crowded_and_extreme_values(spark, bins):
    """Most values lie in a stretch that is no wider than one part in 10**12 of the whole; others are near the largest doubles."""
    r = np.random.default_rng(1)
    v = np.r_[5 + r.random(400) * 1e-6, -1e6, 1e6, r.normal(size=50)]
    wide = [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, 2e-300, 7.0]
    rows = [("A", float(x)) for x in v] + [("B", x) for x in wide] + [("C", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {x.k: x for x in exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}, bins=bins).collect()}
    np.testing.assert_array_equal([got["A"].a, got["A"].b, got["A"].c], [np.sort(v)[int(0.05 * 451)] + (np.sort(v)[int(0.05 * 451) + 1] - np.sort(v)[int(0.05 * 451)]) * (0.05 * 451 - int(0.05 * 451)), *np.quantile(v, [0.5, 1.0])])
    assert got["B"].b == 1e-300 and got["B"].c == 1.7e308 and got[None].b == 3.5 and "C" not in got
    assert exact_quantiles(df.where("k = 'A'"), [], "v", {"b": 0.5}).first().b == np.quantile(v, 0.5)
    assert exact_quantiles(df.where("k = 'none'"), ["k"], "v", {"b": 0.5}).count() == 0


def test_no_task_of_a_quantile_holds_the_values(spark):
    """A million values in one unit: what is shuffled is counts of bins."""
    df = spark.range(1_000_000).select(F.lit("A").alias("k"), (5 + F.rand(1)).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"b": 0.5}).first().b
    assert abs(got - 5.5) < 0.01


def test_rows_without_key_or_time_stay(spark):
    from quotelake.operators import asof, quality

    left = spark.createDataFrame([("X", at("2024-01-01 00:00:02"), 1), (None, at("2024-01-01"), 2), ("X", None, 3)], "asset string, ts timestamp, n int")
    right = spark.createDataFrame([("X", at("2024-01-01 00:00:01"), 7.0), ("X", None, 8.0)], "asset string, seen timestamp, v double")
    for forward in (False, True):
        got = {r.n: r.v for r in asof.asof(left, right, ["asset"], "ts", "seen", ["v"], forward=forward, block_rows=2).collect()}
        assert got == {1: None if forward else 7.0, 2: None, 3: None}
    rows = blocks.with_row_number(left, ["asset"], ["ts"], block_rows=1).collect()
    assert sorted((r.n, r.rn) for r in rows) == [(1, 1), (2, 0), (3, 0)]


def test_a_filtered_position_is_not_taken_for_gapless(spark):
    df = spark.createDataFrame([("X", t, i * 10, 1.0) for i, t in enumerate(times(40))], "asset string, ts timestamp, rn long, v double")
    got = ta.evaluate(df, {"m": ta.sma(ta.number("v"), 5)}, ["asset"], ["ts"], block_rows=50).toPandas()
    assert got.m.isna().sum() == 4


def test_comparisons_with_nan_are_missing(spark):
    df = spark.createDataFrame([("X", at("2024-01-01"), float("nan")), ("X", at("2024-01-02"), 2.0)], "asset string, ts timestamp, v double")
    got = ta.evaluate(df, {"gt": ta.col("v") > 1, "eq": ta.col("v") == ta.col("v")}, ["asset"], ["ts"]).orderBy("ts").collect()
    assert [(r.gt, r.eq) for r in got] == [(None, None), (True, True)]


@pytest.mark.parametrize("block_rows", [7, 64])
def test_ema_does_not_depend_on_where_blocks_are_cut(spark, block_rows):
    values = [float(i % 17) if i % 100 == 3 else None for i in range(900)] + [float(i % 13) for i in range(60)]
    pdf = pd.DataFrame({"asset": "X", "ts": times(len(values), "1s"), "v": values})
    df = spark.createDataFrame([(a, t.to_pydatetime(), None if np.isnan(v) else v) for a, t, v in pdf.itertuples(index=False)], "asset string, ts timestamp, v double")
    v = ta.number("v")
    features = {"e": ta.ema(v, 3), "one": ta.ema(v, 1), "late": ta.lag(ta.ema(v, 3), 2), "twice": ta.ema(ta.ema(v, 2), 4), "long": ta.ema(v, 50)}
    got = ta.evaluate(df, features, ["asset"], ["ts"], block_rows=block_rows).toPandas().sort_values("ts").reset_index(drop=True)
    mean = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
    last = pdf.v.ffill()
    want = {"e": mean(pdf.v, 3), "late": mean(pdf.v, 3).shift(2), "twice": mean(mean(pdf.v, 2), 4), "long": mean(pdf.v, 50), "one": last}
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x.astype(float), rtol=1e-9, atol=1e-9, err_msg=name)
