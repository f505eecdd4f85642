"""Exact quantiles of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from . import blocks

BINS = 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], bins: int = BINS) -> DataFrame:
    """Linear-interpolation quantiles per key without holding or sorting a group anywhere.

    A quantile lies between the values of two ranks. Each rank is found by refining an interval, at first all of the group's values: the values in it
    are counted by bins of equal width, with their extremes, before anything is shuffled, and the bin in which the rank falls is the next
    interval, until it holds a single value. A pass multiplies the resolution by ``bins``, so a few passes do, whether the values are spread out,
    equal, or crowded together; a task never has more than ``bins`` counts of an interval. NULL keys are a group. NULL values do not count,
    and a group of nothing else has no row.
    """
    v = F.col(value).cast("double")
    values = stage(df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v")))
    names = [*keys, "_lo", "_hi"]
    spans = values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if not keys:
        spans = spans.filter("_n > 0")
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(side).alias("_side"), rank(at(q)).cast("long").alias("_rank"), (at(q) - F.floor(at(q))).alias("_w"))
                       for n, q in quantiles.items() for side, rank in (("lo", F.floor), ("hi", F.ceil))])
    ranks = spans.withColumn("_s", F.explode(wanted)).select(*names, "_s.*")
    ranks = stage(ranks)
    found = ranks.filter("_lo = _hi")
    ranks = ranks.filter("_lo < _hi")
    while n := ranks.select(*names).distinct().count():
        inside = ranks.select(*names).distinct()
        counted = _between(values, F.broadcast(inside) if n <= blocks.BROADCAST_SLOTS else inside, keys)
        counted = counted.groupBy(*names, _bin(bins).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        before = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        table = stage(counted.withColumn("_upto", F.sum("_c").over(before)))
        # the rank is counted from the start of its interval
        hit = (F.col("_upto") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
        next_ = blocks.null_safe_join(ranks, table, names, "inner").filter(hit)
        next_ = stage(next_.select(*keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "_name", "_side", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), "_w"))
        found, ranks = found.unionByName(next_.filter("_lo = _hi")), next_.filter("_lo < _hi")
    one = lambda n, side: F.max(F.when((F.col("_name") == n) & (F.col("_side") == side), F.col("_lo")))
    share = lambda n: F.max(F.when(F.col("_name") == n, F.col("_w")))
    return found.groupBy(*keys).agg(*[(one(n, "lo") + (one(n, "hi") - one(n, "lo")) * share(n)).alias(n) for n in quantiles])


def _between(values: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each interval of their group that they lie in; an interval is a few of a group's."""
    other = {c: f"_on_{c}" for c in keys}
    intervals = intervals.withColumnsRenamed(other)
    test = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for c, o in other.items():
        test = test & values[c].eqNullSafe(intervals[o])
    return values.join(intervals, test).drop(*other.values())


def _bin(bins: int) -> Column:
    """The bin of a value between its interval's ends; the ends are never in one bin."""
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")
    wide = hi - lo == F.lit(float("inf"))
    share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
