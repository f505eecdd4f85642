"""A bitmap of row numbers, broadcast to the rows themselves, so that a shuffle moves only rows it may be about.

The bitmap has a fixed size and is made by an aggregate of the numbers. It may take other rows in, never leaves one out, so an exact join follows
where that matters. With more numbers than bits it takes in all rows and the join does what it would have done alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map: at most 2^18 rows of two numbers are broadcast, 4 MB.
BITS = 24


def marked(rows: DataFrame, numbers: DataFrame, column: str = "uid", bits: int = BITS) -> DataFrame:
    """rows with ``_maybe``: false for those whose number surely is not among ``numbers``."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = numbers.select(F.shiftright(at, 6).alias("_word"), (at % 64).cast("int").alias("_at")).distinct().groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_bits"))
    held = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("_word"), "left")
    return held.withColumn("_maybe", F.coalesce(F.getbit("_bits", (at % 64).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")


def without(rows: DataFrame, numbers: DataFrame, column: str = "uid") -> DataFrame:
    """rows whose number is not among ``numbers``, exactly; only those that the map can't tell are shuffled."""
    held = marked(rows, numbers, column)
    return held.where(~F.col("_maybe")).drop("_maybe").unionByName(held.where("_maybe").drop("_maybe").join(numbers, column, "left_anti"))


def repeats(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The uid of each row that is not the first of its key; rows: key, uid; first: key, uid."""
    return rows.select("key", "uid").join(first.select("key", F.col("uid").alias("_first")), "key").where(F.col("uid") != F.col("_first")).select("uid")
