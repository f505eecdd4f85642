"""Connected components of a link table by alternating large and small stars, in shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.session import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v) with u > v. Join every (larger) neighbour of a node, and for small stars the node, to the least of them."""
    both = edges if small else stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if not small else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return stage(moved.where(F.col("u") > F.col("v")).distinct())


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), the component being its smallest node; nodes without a link to another are not listed.

    The links are written in each round, so a lost executor costs a round; a round is a few shuffles of two numbers per link, and their number
    grows with the logarithm of the nodes.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct())
    before = _state(edges)
    while True:
        edges = _star(_star(edges, small=False), small=True)
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
