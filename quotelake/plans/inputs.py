"""The market tables the registered queries read, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bid/ask quotes of eight assets from the event table."""
    bid = 100 + F.col("value") / 100
    spread = F.lit(0.01) * (1 + F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("A"), (F.col("user_id") % 8).cast("string")).alias("asset"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("sequence"),
        bid.alias("bid"),
        (bid + spread).alias("ask"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of five assets from the orders table."""
    price = 100 + F.col("o_totalprice") / 25000
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").cast("timestamp").alias("ts"))
        .agg(
            F.min_by(price, "o_orderkey").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily outside series known one day after the period it describes."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("available_at"))
        .agg(F.avg("l_discount").alias("value"))
    )


# The same three tables as SQL for the oracle.
QUOTES_SQL = """quotes AS (
  SELECT 'A' || CAST(user_id % 8 AS VARCHAR) AS asset, ts, event_id AS sequence,
         100 + value / 100 AS bid, 100 + value / 100 + 1e-2 * (1 + event_id % 5) AS ask
  FROM events)"""
BARS_SQL = """bars AS (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS TIMESTAMP) AS ts,
         arg_min(100 + o_totalprice / 25000, o_orderkey) AS open, max(100 + o_totalprice / 25000) AS high,
         min(100 + o_totalprice / 25000) AS low, arg_max(100 + o_totalprice / 25000, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
EXTERNAL_SQL = """external AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, avg(l_discount) AS value
  FROM lineitem GROUP BY 1)"""


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and show times without a zone, the form results are compared in."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            c = F.round(c, digits) + F.lit(0.0)
        elif f.dataType.typeName() == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)
