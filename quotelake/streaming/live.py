"""Live quotes: closed bars, checks, silence alerts, one-time evaluation, incremental ingest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.resample import side_price


def live_bars(quotes: DataFrame, seconds: int, late: str = "1 minute", side: str = "mid") -> DataFrame:
    """Closed OHLC bars of a quote stream; quotes later than ``late`` are dropped.

    In append mode a bar appears once the watermark has passed its end, never before.
    """
    p, order = side_price(side), F.struct("ts", "sequence")
    w = F.window("ts", f"{seconds} seconds")
    return (
        quotes.withWatermark("ts", late).groupBy("asset", w)
        .agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count(F.lit(1)).alias("quotes"))
        .select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "quotes")
    )


def live_checks(quotes: DataFrame, late: str = "1 minute") -> DataFrame:
    """Valid quotes of a stream, each (asset, ts, sequence) once."""
    good = (F.col("sequence") >= 0) & (F.col("bid") > 0) & (F.col("bid") <= F.col("ask")) & (F.col("ask") < float("inf")) & ~F.isnan("bid")
    return quotes.filter(good).withWatermark("ts", late).dropDuplicatesWithinWatermark(["asset", "ts", "sequence"])


def silence_alerts(quotes: DataFrame, silence_seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """One alert per asset each time no quote came for ``silence_seconds``."""
    s = F.session_window("ts", f"{silence_seconds} seconds")
    return quotes.withWatermark("ts", late).groupBy("asset", s).agg(F.count(F.lit(1)).alias("quotes"), F.max("ts").alias("last_quote")).select(
        "asset", F.col("session_window.start").alias("first_quote"), "last_quote", F.col("session_window.end").alias("alert_at"), "quotes")


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame],
               glob: str | None = None) -> None:
    """Append files that arrived since the last call to an asset/day store; resumes after a failure."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = shape(reader.parquet(source)).withColumn("day", F.to_date("ts"))
    q = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("asset", "day").trigger(availableNow=True).start()
    q.awaitTermination()


def claim_once(frozen: DataFrame, claim_path: str) -> bool:
    """Record that the one evaluation has begun; False when it had before."""
    try:
        frozen.write.mode("errorifexists").json(claim_path)
        return True
    except AnalysisException as e:
        if "ALREADY_EXISTS" in str(e.getCondition() or e):
            return False
        raise


def _folder(asset: str) -> str:
    return hashlib.sha256(asset.encode()).hexdigest()[:32]


def _claimed(spark: SparkSession, claim: str) -> DataFrame | None:
    """Assets whose evaluation has begun."""
    try:
        return spark.read.schema("asset STRING").json(f"{claim}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def prospective_trigger(bars: DataFrame, history: str, claim: str, checkpoint: str, evaluate: Callable[[DataFrame], None],
                        base: int, target: int, min_days: int, need: int = 120) -> None:
    """Collect bars that arrive after a freeze; when an asset has enough, evaluate it once and never again.

    Bars are appended to ``history`` per batch; the endpoint depends on times alone. Each asset has a claim of its own
    under ``claim``, so assets that are due later are evaluated later. Assets already claimed are not read again.
    """
    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # A replayed batch overwrites its own folder, so each bar is kept once.
        batch.write.mode("overwrite").parquet(f"{history}/epoch={epoch}")
        seen = spark.read.parquet(history).drop("epoch")
        done = _claimed(spark, claim)
        if done is not None:
            seen = seen.join(done, "asset", "left_anti")
        seen = seen.dropDuplicates(["asset", "ts"])
        end = evidence.confirmation_end(seen, ["asset"], base, target, min_days, need)
        due = end.filter("end_ts IS NOT NULL").collect()  # a row per asset that has just come due
        won = [r.asset for r in due if claim_once(end.filter(F.col("asset") == r.asset), f"{claim}/{_folder(r.asset)}")]
        if won:
            ends = end.filter(F.col("asset").isin(won))
            evaluate(seen.join(ends, "asset").filter(F.col("ts") <= F.col("end_ts")).drop("end_ts"))

    q = bars.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
