"""Cases of the third round's findings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quotelake.catalog import registry_queries
from quotelake.functions import guards, ta
from quotelake.functions.sampling import PRIME, WEIGHTS
from quotelake.operators import asof, blocks
from quotelake.operators import registry as rg
from quotelake.sources import hour_files

def test_short_deviations_follow_the_textbook_update(spark):
    """One price written as two neighbouring doubles: the textbook's update gives 0 here, Spark's aggregate 5.8e-15 (F2)."""
    a, b = 100.28490000000001, 100.2849
    df = spark.createDataFrame([("X", i, v) for i, v in enumerate([a, b, b, b, a, a, b, b, 1.0, 2.0, 4.0, None])], "asset STRING, ts LONG, x DOUBLE")
    df = df.withColumn("ts", F.timestamp_micros(F.col("ts") * 1_000_000))
    got = [r.sd for r in ta.evaluate(df, {"sd": ta.std(ta.number("x"), 4)}, ["asset"], ["ts"]).orderBy("ts").collect()]

    def welford(values):
        n, mean, m2 = 0, 0.0, 0.0
        for v in values:
            n, d = n + 1, v - mean
            mean += d / n
            m2 += d * (v - mean)
        return (m2 / (n - 1)) ** 0.5

    xs = [a, b, b, b, a, a, b, b, 1.0, 2.0, 4.0]
    assert got[:3] == [None] * 3 and got[11] is None
    assert got[3:11] == [welford(xs[i - 3 : i + 1]) for i in range(3, 11)] and got[3] == 0.0

def test_ordered_mean_does_not_depend_on_the_split(spark):
    """A sum of doubles depends on its order; how rows are split over tasks must not decide it (F3)."""
    rows = [(k, i, v) for k in range(40) for i, v in enumerate([0.1, 0.01, 0.02, 0.06, 0.09, 0.02])] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "k LONG, place LONG, v DOUBLE")
    want = 0.0
    for v in [0.1, 0.01, 0.02, 0.06, 0.09, 0.02]:
        want += v
    for cut in (df.coalesce(1), df.repartition(7, "place"), df.orderBy(F.desc("place"))):
        got = dict(cut.groupBy("k").agg(guards.ordered_mean("v", "place").alias("m")).collect())
        assert got.pop(99) is None and set(got.values()) == {want / 6}


def _rules(spark, rows):
    columns = "rule LONG, family STRING, regime STRING, fast DOUBLE, slow DOUBLE, threshold DOUBLE, allocation DOUBLE, stop_loss DOUBLE, take_profit DOUBLE, max_holding DOUBLE"
    return spark.createDataFrame(rows, columns)


RULES = [(i, "mean_reversion", "low_volatility", 3.0 + i % 5, 20.0 + i % 4 * 10, 1.0, 0.9, 0.05, 0.1, 10.0 + i) for i in range(30)]
# Bounds leave these two parameters, so there are fewer joint changes than asked for and every try is needed.
NARROW = [(100 + i, "breakout", "none", 5.0, 20.0 + i, 1.0, 0.01 / 1.2, 0.005 / 1.2, 0.01 / 1.2, 2.0) for i in range(5)]


def test_rule_grids_work_in_parts_and_alike(spark, monkeypatch):
    """However small the parts are, a rule given twice counts once and values that both bounds reach stay one (F4)."""
    rules = _rules(spark, RULES + NARROW + RULES[:3])
    whole = {tuple(r) for r in rg.param_grid(rules, "rule").collect()}
    monkeypatch.setattr(rg, "TASK_ROWS", 64)
    parts = rg.param_grid(rules, "rule")
    rows = [tuple(r) for r in parts.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == whole
    assert parts.rdd.getNumPartitions() == -(-38 * 14 // 64)
    assert [r for r in rows if r[0] == 100 and r[1] == "take_profit"] == [(100, "take_profit", 0.01, 0.8)]


def test_joint_grid_equals_a_loop(spark):
    def drawn(seed, *parts):
        x = seed
        for w, p in zip(WEIGHTS, parts):
            x += p % PRIME * w
        x %= PRIME
        for k in (1, 2, 3):
            x = (x * x % PRIME + x * 48_271 % PRIME + k) % PRIME
        return x

    rules = _rules(spark, RULES + NARROW)
    options = {}
    for r in rg.param_grid(rules, "rule").collect():
        options.setdefault((r.rule, r.parameter), []).append(r.value)
    want = set()
    for r in RULES + NARROW:
        seen = {}
        for t in range(80):
            made = {}
            for slot, name in enumerate(rg.BOUNDS, 1):
                o = sorted(options.get((r[0], name), []))
                if o and drawn(42, r[0], t, slot) % 2:
                    made[name] = o[drawn(43, r[0], t, slot) % len(o)]
            if len(made) >= 2 and made.get("fast", r[3]) < made.get("slow", r[4]):
                seen.setdefault(";".join(f"{n}={round(v * 1e6)}" for n, v in made.items()), (t, len(made)))
        want |= {(r[0], c, *v) for c, v in sorted(seen.items(), key=lambda x: x[1])[:8]}
    got = [tuple(r) for r in rg.joint_grid(rules, "rule").collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(t >= 16 for _, _, t, _ in got)  # the second turn was needed


def test_joint_tries_are_shuffled_once(spark):
    """Repeats are dropped and the first tries taken where a rule's tries arrive, with no join and no second shuffle (F1)."""
    one = _rules(spark, RULES).select("rule", F.array(F.struct("fast", "slow")).alias("_own"), *[F.array(F.col(n) * 0.8, F.col(n) * 1.2).alias(n) for n in rg.BOUNDS])
    made = rg._joint(one, "rule", 8, 80, 42)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_overlaps_are_counted_before_they_are_shuffled(spark, monkeypatch):
    """Ten thousand intervals of ten days are twenty rows of the time line (F5)."""
    day = F.expr("timestamp '2024-01-01'")
    taken = spark.range(10_000).select((day + F.make_dt_interval((F.col("id") % 10).cast("int"))).alias("start")).withColumn("end", F.col("start") + F.expr("INTERVAL 1 DAY"))
    requests = spark.createDataFrame([(1, 3, 3), (2, 0, 20), (3, 11, 12)], "id LONG, a INT, b INT").select("id", (day + F.make_dt_interval("a")).alias("start"), (day + F.make_dt_interval("b")).alias("end"))
    seen, split = [], blocks.split
    monkeypatch.setattr(blocks, "split", lambda line, *a, **k: seen.append(line.count()) or split(line, *a, **k))
    assert {(r.id, r.overlaps) for r in asof.count_overlaps(requests, taken).collect()} == {(1, 2000), (2, 10_000), (3, 0)}
    assert seen == [20 + 6]


def test_hours_are_encoded_one_at_a_time():
    """The encoder sees the quotes of one hour, not a batch of all hours as lists (F9)."""
    hour = pa.table({"asset": ["X"] * 3, "hour": pa.array([0] * 3, pa.timestamp("us", "UTC")), "ms": [20, 10, 10], "sequence": [1, 3, 2], "bid": [1.0, 3.0, 2.0], "ask": [1.5, 3.5, 2.5]})
    file = registry_queries._encode(hour).to_pylist()
    assert len(file) == 1
    records = next(hour_files._pieces(file[0]["content"]))
    assert records["ms"].tolist() == [10, 10, 20] and records["bid"].tolist() == [200_000, 300_000, 100_000]
