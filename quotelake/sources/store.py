"""The partitioned quote store: planned writes, range reads, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .readers import SourceError


def write_plan(incoming: DataFrame, existing: DataFrame, as_of: str, replace: bool = False) -> DataFrame:
    """What would happen to each incoming asset-day: write, exists or incomplete."""
    days = incoming.groupBy("asset", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("ticks"))
    known = existing.select("asset", "day").distinct().withColumn("_known", F.lit(True))
    done = F.date_add("day", 1).cast("timestamp") <= F.lit(as_of).cast("timestamp")
    action = F.when(~done, F.lit("incomplete"))
    if not replace:
        action = action.when(F.col("_known"), F.lit("exists"))
    return days.join(known, ["asset", "day"], "left").select("asset", "day", "ticks", action.otherwise(F.lit("write")).alias("action"))


def put_days(spark: SparkSession, incoming: DataFrame, path: str, as_of: str, existing: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """Write whole asset-days; refuse days that exist (unless replacing) or are not over.

    Only the planned days are touched: with ``replace`` their partitions are overwritten.
    ``existing`` (asset, day) may name the days the store holds; by default they are looked up.
    """
    if existing is None:
        existing = stored_days(spark, path)
    plan = write_plan(incoming, existing, as_of, replace)
    refused = plan.filter("action <> 'write'").limit(1).collect()
    if refused:
        raise SourceError(f"day {refused[0]['day']} of {refused[0]['asset']}: {refused[0]['action']}")
    rows = incoming.withColumn("day", F.to_date("ts"))
    # An asset-day may be large: spread it over hours, each task writes its own files.
    spread = rows.repartition("asset", "day", F.hour("ts")).sortWithinPartitions("asset", "day", "ts", "sequence")
    (spread.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("asset", "day").parquet(path))
    return plan


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The asset-days a store holds; none if there is no store yet."""
    try:
        held = spark.read.schema("ts TIMESTAMP, sequence LONG, bid DOUBLE, ask DOUBLE, asset STRING, day DATE").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "asset STRING, day DATE")
    return held.select("asset", "day").distinct()


def read_range(spark: SparkSession, path: str, start: str, end: str, assets: list[str] | None = None) -> DataFrame:
    """Quotes with start <= ts < end; the day range is added so whole partitions are skipped."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    q = spark.read.schema("ts TIMESTAMP, sequence LONG, bid DOUBLE, ask DOUBLE, asset STRING, day DATE").parquet(path)
    if assets is not None:
        q = q.filter(F.col("asset").isin(*assets))
    q = q.filter((F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(hi)))
    return q.filter((F.col("ts") >= lo) & (F.col("ts") < hi))


def status(days: DataFrame) -> DataFrame:
    """Per asset: days, first and last day, quotes, days needing review."""
    return days.groupBy("asset").agg(
        F.count(F.lit(1)).alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.sum("ticks").alias("ticks"), F.sum(F.when(F.col("status") == "NEEDS_REVIEW", 1).otherwise(0)).alias("needs_review"))
