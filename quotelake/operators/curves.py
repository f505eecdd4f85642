"""Growth, extremes and drawdown of a curve as one value that merges.

A stretch of returns acts on a curve through four numbers: its growth, its highest and lowest point, and its inner drawdown, all against
where it starts. Two stretches in a row act like one that is put together from their numbers, whatever came first: the numbers
form a monoid. So a long curve is folded in chunks, the chunks in chunks, and so on: a tree of merges whose groups
have a bounded number of rows, spread over all tasks, instead of one window over the curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows or summaries folded at once.
FANOUT = 64


def empty() -> Column:
    return F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("hi"), F.lit(1.0).alias("lo"), F.lit(0.0).alias("dd"))


def step(a: Column, r: Column) -> Column:
    """A stretch and one more return."""
    p = a["p"] * (1 + r)
    hi = F.greatest(a["hi"], p)
    return F.struct(p.alias("p"), hi.alias("hi"), F.least(a["lo"], p).alias("lo"), F.greatest(a["dd"], 1 - p / hi).alias("dd"))


def merge(a: Column, b: Column) -> Column:
    """One stretch and the next."""
    return F.struct(
        (a["p"] * b["p"]).alias("p"), F.greatest(a["hi"], a["p"] * b["hi"]).alias("hi"), F.least(a["lo"], a["p"] * b["lo"]).alias("lo"),
        F.greatest(a["dd"], b["dd"], 1 - a["p"] * b["lo"] / a["hi"]).alias("dd"))


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def merged(summaries: DataFrame, keys: list[str], order: str, summary: str, fanout: int = FANOUT, longest: int | None = None) -> DataFrame:
    """One summary per key from those of its stretches, in the order of the integer column ``order``, which is unique in a key and not negative.

    ``longest`` bounds ``order``, if the caller knows it; else it is looked up.
    """
    if longest is None:
        longest = summaries.agg(F.max(order)).first()[0] or 0
    df = summaries.select(*keys, F.col(order).cast("long").alias("_o"), F.col(summary).alias("_s"))
    while True:
        chunk = F.floor(F.col("_o") / fanout)
        df = df.groupBy(*keys, chunk.alias("_c")).agg(_in_order("_o", "_s").alias("_l")).select(*keys, F.col("_c").alias("_o"), F.aggregate("_l", empty(), merge).alias("_s"))
        longest //= fanout
        if not longest:
            return df.select(*keys, F.col("_s").alias(summary))


def summaries(rows: DataFrame, keys: list[str], order: str, ret: str, fanout: int = FANOUT) -> DataFrame:
    """The summary ``curve`` of each key's returns, in the order of the integer column ``order``, which is unique in a key and not negative."""
    chunks = rows.groupBy(*keys, F.floor(F.col(order) / fanout).alias("_chunk")).agg(_in_order(order, ret).alias("_l"))
    return merged(chunks.select(*keys, "_chunk", F.aggregate("_l", empty(), step).alias("curve")), keys, "_chunk", "curve", fanout)
