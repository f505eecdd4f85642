"""File sources and sinks with fixed schemas; nothing is inferred, bad input fails."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import finite, required
from ..session import prepare

QUOTE_CSV = "timestamp STRING, sequence LONG, bid DOUBLE, ask DOUBLE"
BAR_CSV = "timestamp STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
# An ISO time is accepted only with its offset.
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


class SourceError(ValueError):
    """An input that breaks its declared contract."""


def exact_time(text: Column) -> Column:
    """A timestamp from text that names its offset; NULL otherwise."""
    return F.when(text.rlike(OFFSET), F.to_timestamp(text))


def _time(name: str) -> Column:
    text = F.col(name)
    return required(exact_time(text), F.coalesce(text.rlike(OFFSET), F.lit(False)), f"{name}: a time without its offset")


def _number(name: str) -> Column:
    c = F.col(name)
    return required(c, c.isNull() | finite(c).isNotNull(), f"{name}: not a finite number").alias(name)


def _header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(sep) if first else []


def _strict_csv(spark: SparkSession):
    """A reader that fails on a malformed row and on any file whose header is not the schema's."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)


def read_quotes_csv(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """Quotes from CSV with exactly timestamp, sequence, bid, ask. ``path`` may be a folder; each file's header is checked as it is scanned."""
    want = ["timestamp", "sequence", "bid", "ask"]
    if _header(prepare(spark), path) != want:
        raise SourceError(f"quote files hold exactly the columns {want}")
    raw = _strict_csv(spark).schema(QUOTE_CSV).csv(path)
    return raw.select(F.lit(asset).alias("asset"), _time("timestamp").alias("ts"), "sequence", _number("bid"), _number("ask"))


def read_bars_manifest(spark: SparkSession, path: str) -> DataFrame:
    """OHLC files listed by a JSON manifest: {"datasets": [{"asset", "path"}, ...]}."""
    text = "\n".join(r[0] for r in prepare(spark).read.text(path).collect())
    listed = json.loads(text)["datasets"]
    names = [d["asset"] for d in listed]
    if len(set(names)) != len(names):
        raise SourceError("an asset is listed twice")
    out = None
    for d in listed:
        cols = [c.lower() for c in _header(spark, d["path"])]
        if not {"timestamp", "open", "high", "low", "close"} <= set(cols):
            raise SourceError("bar files need timestamp, open, high, low, close")
        schema = T.StructType([T.StructField(c, T.StringType() if c == "timestamp" else T.DoubleType()) for c in cols])
        raw = _strict_csv(spark).schema(schema).csv(d["path"])
        part = raw.select(F.lit(d["asset"]).alias("asset"), _time("timestamp").alias("ts"), *[_number(c) for c in cols if c != "timestamp"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sniff_separator(line: str) -> str:
    return max(",;\t|", key=line.count)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A signal or trade trace; the separator is the commonest one of the header."""
    head = prepare(spark).read.text(path).limit(1).collect()[0][0]
    sep = sniff_separator(head)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.split(sep)])
    return normalize_trace(spark.read.schema(schema).option("header", True).option("sep", sep).csv(path))


def trace_time(text: Column) -> Column:
    """Epoch seconds or ISO text as a timestamp."""
    return F.when(text.rlike(r"^\d+$"), F.timestamp_seconds(text.try_cast("long"))).otherwise(F.try_to_timestamp(text))


def normalize_trace(raw: DataFrame) -> DataFrame:
    """Times to timestamps, long/short to +1/-1."""
    if "signal_timestamp" in raw.columns:
        raw = raw.withColumn("timestamp", F.col("signal_timestamp"))
    for c in ("timestamp", "entry_timestamp", "exit_timestamp"):
        if c in raw.columns:
            raw = raw.withColumn(c, trace_time(F.col(c)))
    if "direction" in raw.columns:
        d = F.col("direction")
        raw = raw.withColumn("direction", F.when(d == "long", 1).when(d == "short", -1).otherwise(d.try_cast("int")))
    return raw


def read_release_csv(spark: SparkSession, path: str, name: str, available: str, value: str, max_age_days: int) -> DataFrame:
    """An external series from a release file: when a value became known, and the value."""
    cols = _header(prepare(spark), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    raw = _strict_csv(spark).schema(schema).csv(path)
    return raw.select(F.lit(name).alias("series"), exact_time(F.col(available)).alias("available_at"), finite(F.col(value).cast("double")).alias("value"),
                      F.lit(max_age_days).alias("max_age_days"))


def write_json(df: DataFrame, path: str) -> None:
    """Trades, orders or equity as JSON lines, ignoring nothing."""
    df.write.option("ignoreNullFields", False).json(path)


def export_features(df: DataFrame, columns: list[str], path: str) -> None:
    """Features keyed by epoch second, semicolon separated, blanks for missing values."""
    df.select(F.unix_seconds("ts").alias("timestamp_utc"), *columns).write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)


def export_signals(rows: DataFrame, warmup: int) -> DataFrame:
    """Reference signals without the warm-up rows and the last bar (needs ``rn``)."""
    last = rows.groupBy("asset").agg(F.max("rn").alias("_last"))
    d = F.col("direction") if "direction" in rows.columns else F.lit(1)
    return rows.join(last, "asset").filter((F.col("rn") > warmup) & (F.col("rn") < F.col("_last"))).select(
        "asset", "ts", F.col("entry").cast("int").alias("entry"), F.col("exit").cast("int").alias("exit"), d.alias("direction"))
