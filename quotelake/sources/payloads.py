"""Array and document payloads to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import required

SERIES_DOC = ("name STRING, source_url STRING, availability_description STRING, max_age_days INT, "
              "observations ARRAY<STRUCT<available_at: STRING, value: DOUBLE>>")


def decode_delta_candles(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Delta-coded candle arrays to bars; one payload per ``keys``, gaps stay gaps.

    Columns: base_ms, shift, multiplier, times[], and open, high, low, close with their
    change arrays opens[], highs[], lows[], closes[].
    """
    fields = ("open", "high", "low", "close")
    lengths = [F.size("times") == F.size(f"{f}s") for f in fields]
    equal = lengths[0] & lengths[1] & lengths[2] & lengths[3]
    sound = F.coalesce(equal & (F.col("multiplier") > 0) & (F.col("shift") > 0) & F.forall("times", lambda t: t >= 0), F.lit(False))
    zipped = required(F.arrays_zip("times", *[f"{f}s" for f in fields]), sound, "a candle payload with unequal arrays, a scale or step of zero or less, or a step back in time")
    rows = payloads.select(*keys, "base_ms", "shift", "multiplier", *fields, F.posexplode(zipped).alias("pos", "d"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = lambda f: (F.bround(F.col(f) / F.col("multiplier")) + F.sum(f"d.{f}s").over(w)) * F.col("multiplier")
    ms = F.col("base_ms") + F.sum("d.times").over(w) * F.col("shift")
    return rows.select(*keys, F.timestamp_micros((ms * 1000).cast("long")).alias("ts"), *[level(f).alias(f) for f in fields])


def explode_candles(payloads: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Candle rows [epoch s, low, high, open, close, volume] clipped to [start, end)."""
    c = lambda i: F.col("c")[i]
    rows = payloads.select(*keys, F.explode("candles").alias("c")).select(
        *keys, F.timestamp_seconds(c(0).cast("long")).alias("ts"), c(3).alias("open"), c(2).alias("high"), c(1).alias("low"), c(4).alias("close"), c(5).alias("volume"))
    return rows.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def parse_series_documents(texts: DataFrame, column: str = "doc") -> DataFrame:
    """External-series documents to a long table; a malformed document fails the read."""
    doc = texts.select(F.from_json(column, SERIES_DOC, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return doc.select("name", "source_url", "availability_description", "max_age_days", F.inline("observations")).withColumn(
        "available_at", F.try_to_timestamp("available_at"))


def series_problems(rows: DataFrame) -> DataFrame:
    """What is wrong with each loaded series, if anything."""
    from ..functions.guards import finite

    dup = rows.groupBy("name", "available_at").agg(F.count(F.lit(1)).alias("_n")).groupBy("name").agg((F.max("_n") > 1).alias("_dup"))
    a = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("observations"), F.max(finite(F.col("value")).isNull()).alias("_nf"), F.max(F.col("available_at").isNull()).alias("_nt"),
        F.max(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))).alias("_src"),
        F.max(F.coalesce(F.length("availability_description"), F.lit(0)) == 0).alias("_desc"), F.min("max_age_days").alias("_age"),
    ).join(dup, "name")
    found = F.array_compact(F.array(
        F.when(~F.col("name").rlike("^[a-z][a-z0-9_]*$"), F.lit("name")), F.when(F.col("_src"), F.lit("source")), F.when(F.col("_desc"), F.lit("description")),
        F.when(F.coalesce(F.col("_age"), F.lit(0)) <= 0, F.lit("max_age")), F.when(F.col("_nt"), F.lit("time")), F.when(F.col("_dup"), F.lit("duplicate_time")),
        F.when(F.col("_nf"), F.lit("not_finite"))))
    return a.select("name", "observations", F.concat_ws(",", found).alias("problems"))
