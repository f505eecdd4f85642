"""Registered streaming queries, each run over the whole event table until it has caught up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.inputs import bars, report, table
from ..session import checkpoint_dir
from ..streaming import live
from .common import with_views
from .evidence_queries import CONFIRMED
from .time_queries import H4, MID, ohlc

LATE_SECONDS = 3600


def quote_stream(s, d):
    """The event table as a file stream of quotes."""
    schema = table(s, d, "events").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    bid = 100 + F.col("value") / 100
    return e.select(F.concat(F.lit("A"), (F.col("user_id") % 8).cast("string")).alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"),
                    bid.alias("bid"), (bid + F.lit(0.01) * (1 + F.col("event_id") % 5)).alias("ask"))


def caught_up(s, stream):
    """Run a stream over what is there and read what it appended."""
    root = f"{checkpoint_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{root}/out")


def incremental_ingest(s, d):
    root = f"{checkpoint_dir(s).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    schema = table(s, d, "events").schema
    shape = lambda e: e.select(F.concat(F.lit("A"), (F.col("user_id") % 8).cast("string")).alias("asset"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"))
    for _ in range(2):  # The second call finds nothing new.
        live.ingest_new(s, d, schema, f"{root}/out", f"{root}/state", shape, "events.parquet")
    got = s.read.schema("ts TIMESTAMP, sequence LONG, asset STRING, day DATE").parquet(f"{root}/out")
    return got.groupBy("asset", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("quotes"))


def prospective_trigger(s, d):
    """Each asset's bars arrive as a stream; the one evaluation of each counts what it was given."""
    root = f"{checkpoint_dir(s).rstrip('/')}/trigger-{uuid.uuid4().hex}"
    rows = bars(s, d).select("asset", "ts", "close")
    rows.write.parquet(f"{root}/in")
    count = lambda df: df.groupBy("asset").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("end_ts")).write.mode("append").parquet(f"{root}/out")
    for _ in range(2):  # The second call finds nothing new and evaluates nothing again.
        live.prospective_trigger(s.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/seen", f"{root}/claim", f"{root}/state", count, 86400, 86400, 200)
    return report(s.read.schema("asset STRING, bars LONG, end_ts TIMESTAMP").parquet(f"{root}/out"))


END = f"(SELECT max(ts) FROM quotes) - INTERVAL {LATE_SECONDS} SECOND"

QUERIES = {
    "stream_bars": (
        lambda s, d: report(caught_up(s, live.live_bars(quote_stream(s, d), H4, f"{LATE_SECONDS} seconds"))),
        with_views("quotes", f"b AS ({ohlc(H4, MID)}), n AS (SELECT asset, make_timestamp(CAST(floor(epoch_us(ts) / {H4}e6) AS BIGINT) * {H4} * 1000000) AS ts, count(*) AS quotes FROM quotes GROUP BY 1, 2)",
                   select=f"SELECT asset, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, quotes FROM b JOIN n USING (asset, ts) WHERE ts + INTERVAL 4 HOUR <= {END}"),
    ),
    "stream_quote_checks": (
        lambda s, d: report(caught_up(s, live.live_checks(quote_stream(s, d), f"{LATE_SECONDS} seconds"))),
        with_views("quotes", select="SELECT asset, ts, sequence, round(bid, 6) AS bid, round(ask, 6) AS ask FROM quotes"),
    ),
    "stream_silence_alerts": (
        lambda s, d: report(caught_up(s, live.silence_alerts(quote_stream(s, d), 3600, f"{LATE_SECONDS} seconds"))),
        with_views("quotes", """g AS (SELECT asset, ts, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts) AS k FROM (
            SELECT asset, ts, lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS before FROM quotes)),
          s AS (SELECT asset, min(ts) AS first_quote, max(ts) AS last_quote, max(ts) + INTERVAL 1 HOUR AS alert_at, count(*) AS quotes FROM g GROUP BY asset, k)""",
                   select=f"SELECT * FROM s WHERE alert_at <= {END}"),
    ),
    "prospective_trigger": (
        prospective_trigger,
        with_views("bars", CONFIRMED, select="SELECT c.asset, count(*) AS bars, end_ts FROM confirmed c JOIN bars b ON b.asset = c.asset AND b.ts <= end_ts GROUP BY ALL"),
    ),
    "incremental_ingest": (
        incremental_ingest,
        with_views("quotes", select="SELECT asset, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS quotes FROM quotes GROUP BY 1, 2"),
    ),
}
