"""Registered resampling, as-of, overlap and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ta
from ..functions.guards import floor_ts
from ..operators import asof, blocks, quality, segments
from ..operators import resample as rs
from ..plans.enrich import enrich
from ..plans.inputs import bars, external, quotes, report, table
from .common import with_views

H4, DAY = 14400, 86400


def bucket(seconds: int, ts: str = "ts") -> str:
    return f"make_timestamp(CAST(floor(epoch_us({ts}) / {seconds}e6) AS BIGINT) * {seconds} * 1000000)"


def ohlc(seconds: int, price: str, source: str = "quotes", where: str = "") -> str:
    return f"""SELECT asset, {bucket(seconds)} AS ts, arg_min({price}, (ts, sequence)) AS open, max({price}) AS high,
      min({price}) AS low, arg_max({price}, (ts, sequence)) AS close FROM {source} {where} GROUP BY 1, 2"""


R4 = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"
MID = "(bid + ask) / 2"
SIGNAL_4H = f"""first_tick AS (SELECT asset, min(ts) AS first FROM quotes GROUP BY 1), all4 AS ({ohlc(H4, MID)}),
  sig4 AS (SELECT a.* FROM all4 a JOIN first_tick f USING (asset) WHERE a.ts >= f.first)"""
HOURLY = f"hourly AS ({ohlc(3600, 'bid')})"
ROLLED = f"""rolled AS (SELECT asset, b AS ts, open, high, low, close FROM (
    SELECT asset, {bucket(H4)} AS b, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
      count(*) AS n, max(ts) AS last FROM hourly GROUP BY 1, 2) WHERE n = 4 AND last = b + INTERVAL 3 HOUR)"""


def hourly(s, d):
    return rs.quotes_to_bars(quotes(s, d), 3600, "bid")


def signal_schedule(s, d):
    h = hourly(s, d)
    coarse = rs.rollup_complete(h, 3600, H4)
    rule = ta.signal(ta.number("close") > ta.sma(ta.number("close"), 3))
    decided = ta.evaluate(coarse, {"entry": rule}, ["asset"], ["ts"]).select(
        "asset", "ts", "entry", (~F.col("entry")).alias("exit"), F.col("close").alias("signal_price"))
    out = rs.schedule(h, decided, 3600, H4)
    return report(out.select("asset", "ts", "entry", "exit", "decision", "signal_price"))


def common_range(s, d):
    a = F.substring("asset", 1, 1).cast("int")
    b = bars(s, d).filter(F.col("ts") >= F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval(a * 30))
    out = rs.common_range(b)
    return report(out.groupBy("asset").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last")))


def curve_downsample(s, d):
    out = rs.curve_downsample(quotes(s, d).withColumn("equity", (F.col("bid") + F.col("ask")) / 2), ["asset"], ["ts", "sequence"], "equity", 800)
    return report(out.select("asset", "position", "equity", "drawdown"))


def cross_market(s, d):
    sources = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = asof.cross_market(bars(s, d), sources, ["close", "volume"], DAY)
    return report(out.select("asset", "ts", *[c for c in out.columns if c.startswith("market_")]))


def enriched(s, d):
    sources = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = enrich(bars(s, d), sources, ["close", "volume"], DAY, {"discount": (external(s, d), 7)})
    return report(out.select("asset", "ts", "weekday", "month", "day", "external_discount", *[c for c in out.columns if c.startswith("market_")]))


def _cross_sql(more: str = "", joined: str = "") -> str:
    tags = {"1-URGENT": "1_urgent", "2-HIGH": "2_high", "3-MEDIUM": "3_medium", "4-NOT SPECIFIED": "4_not_specified", "5-LOW": "5_low"}
    joins, cols = "", ""
    for i, (a, tag) in enumerate(tags.items()):
        joins += f"\nASOF LEFT JOIN (SELECT ts + INTERVAL 1 DAY AS at, close, volume FROM bars WHERE asset = '{a}') m{i} ON t.ts >= m{i}.at"
        near = f"m{i}.at >= t.ts - INTERVAL 7 DAY"
        cols += f", CASE WHEN {near} THEN round(m{i}.close, 6) END AS market_{tag}_close, CASE WHEN {near} THEN m{i}.volume END AS market_{tag}_volume"
    return f"SELECT t.asset, t.ts{more}{cols} FROM bars t{joins}{joined}"


def external_asof(s, d):
    out = asof.asof(bars(s, d), external(s, d), [], "ts", "available_at", ["value", "available_at"], strict=True,
                    tolerance_seconds=7 * DAY, prefix="external_")
    return report(out.select("asset", "ts", "external_value", "external_available_at"))


def next_tick(s, d):
    t = quotes(s, d)
    b = rs.signal_bars(t, H4, "mid").withColumn("closes", F.timestamp_micros(F.unix_micros("ts") + H4 * 1_000_000))
    out = asof.asof(b, t, ["asset"], "closes", "ts", ["sequence", "ts"], forward=True, right_order="sequence", prefix="tick_")
    return report(out.select("asset", "ts", F.coalesce("tick_sequence", F.lit(-1)).alias("tick_sequence"), "tick_ts"))


def latency_fill(s, d):
    t = quotes(s, d)
    triggers = t.withColumn("ready", F.timestamp_micros(F.unix_micros("ts") + 1500 * 1000 * 60))
    out = asof.asof(triggers, t, ["asset"], "ready", "ts", ["sequence", "ask"], forward=True, right_order="sequence", prefix="fill_")
    return report(out.select("asset", "sequence", F.coalesce("fill_sequence", F.lit(-1)).alias("fill_sequence"), "fill_ask"))


def interval_overlap(s, d):
    """Can each order-date window of a customer segment still be held out?"""
    o = table(s, d, "orders")
    requests = o.groupBy("o_orderpriority", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y")).agg(
        F.min("o_orderdate").cast("timestamp").alias("start"), F.max("o_orderdate").cast("timestamp").alias("end"))
    requests = requests.withColumn("id", F.concat_ws("/", "o_orderpriority", F.col("y").cast("string"), F.col("m").cast("string")))
    taken = table(s, d, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("start"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_quantity").cast("long") * 86_400_000_000).alias("end"))
    return asof.count_overlaps(requests.select("id", "start", "end"), taken).select(
        "id", "overlaps", (F.col("overlaps") == 0).alias("free"))


def trace_reconcile(s, d):
    b = bars(s, d).withColumn("direction", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    n = F.unix_date(F.to_date("ts"))
    seen = b.filter(n % 97 != 3).withColumn("close", F.when(n % 89 == 4, F.col("close") + 0.001).when(n % 83 == 5, F.lit(None)).otherwise(F.col("close") + 1e-9))
    seen = seen.withColumn("direction", F.when(n % 79 == 6, -F.col("direction")).otherwise(F.col("direction")))
    late = b.filter(n % 71 == 7).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    seen = seen.unionByName(b.filter(n % 61 == 8)).unionByName(late)
    return segments.reconcile(b, seen, ["asset", "ts"], ["open", "close"], ["direction"], 1e-8)


RECONCILE = """b AS (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS direction, date_diff('day', TIMESTAMP '1970-01-01', ts) AS n FROM bars),
  seen AS (SELECT asset, ts, open, CASE WHEN n % 89 = 4 THEN close + 1e-3 WHEN n % 83 = 5 THEN NULL ELSE close + 1e-9 END AS close,
      CASE WHEN n % 79 = 6 THEN -direction ELSE direction END AS direction FROM b WHERE n % 97 <> 3
    UNION ALL SELECT asset, ts, open, close, direction FROM b WHERE n % 61 = 8
    UNION ALL SELECT asset, ts + INTERVAL 1 HOUR, open, close, direction FROM b WHERE n % 71 = 7),
  dup AS (SELECT asset, ts FROM seen GROUP BY 1, 2 HAVING count(*) > 1),
  pairs AS (SELECT b.open AS ro, b.close AS rc, b.direction AS rd, s.open AS so, s.close AS sc, s.direction AS sd FROM b JOIN seen s USING (asset, ts)
    WHERE (asset, ts) NOT IN (SELECT (asset, ts) FROM dup)),
  c AS (SELECT (SELECT count(*) FROM b) AS expected_rows, (SELECT count(*) FROM seen) AS observed_rows,
    (SELECT count(*) FROM b ANTI JOIN seen USING (asset, ts)) AS missing, (SELECT count(*) FROM seen ANTI JOIN b USING (asset, ts)) AS extra,
    (SELECT count(*) FROM dup) AS duplicated,
    (SELECT count(*) FROM pairs WHERE NOT coalesce(abs(ro - so) <= 1e-8, FALSE)) AS mismatch_open,
    (SELECT count(*) FROM pairs WHERE NOT coalesce(abs(rc - sc) <= 1e-8, FALSE)) AS mismatch_close,
    (SELECT count(*) FROM pairs WHERE rd IS DISTINCT FROM sd) AS mismatch_direction)"""


def segment_split(s, d):
    t = quotes(s, d)
    span = t.groupBy("asset").agg(floor_ts(F.min("ts"), 3600).alias("start"), floor_ts(F.max("ts"), 3600).alias("end"))
    seg = segments.calendar_segments(span, 3600)
    rows = segments.assign_segment(t.select("asset", "ts"), seg)
    return report(rows.groupBy("asset", "segment").agg(F.count(F.lit(1)).alias("quotes"), F.min("ts").alias("first"), F.max("ts").alias("last")))


def first_touch(s, d):
    """From each bar, the first of the next 30 closes 8 % below or 10 % above it."""
    b = blocks.with_row_number(bars(s, d), ["asset"], ["ts"])
    e = b.select("asset", F.col("rn").alias("from"), (F.col("rn") + 30).alias("to"),
                 (F.col("close") * 0.92).alias("lower"), (F.col("close") * 1.1).alias("upper"))
    return asof.first_touch(e, b, ["asset"], low="close", high="close", bucket=8, span=30).select(
        "asset", F.col("from").alias("entry_row"), F.col("at").alias("touch_row"))


def settings_resolve(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("asset"), "c_mktsegment", "c_custkey", "c_acctbal")
    profiles = c.filter(F.col("c_mktsegment") != "BUILDING").select(
        "asset", F.when(F.col("c_mktsegment") == "MACHINERY", 3.0).otherwise(2.0).alias("spread_bps"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.lit(1.0)).alias("slippage_bps"))
    overrides = c.filter(F.col("c_acctbal") < 0).select("asset", (F.col("c_custkey") % 10).cast("double").alias("slippage_bps"))
    return report(segments.resolve_settings(c.select("asset"), profiles, overrides,
                                            {"spread_bps": 5.0, "slippage_bps": 5.0, "commission_rate": 0.001}))


def scenario_grid(s, d):
    """Bars each scenario of the grid would read."""
    b = bars(s, d)
    rules = s.createDataFrame([("trend", 5, 20), ("trend", 4, 20), ("dip", 5, 50)], "family string, fast int, slow int")
    grid = segments.scenario_grid(b.select("asset").distinct(), rules, [1, 2, 3], ["training", "validation"])
    span = b.groupBy("asset").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    rows = segments.assign_segment(b.select("asset", "ts"), segments.calendar_segments(span))
    n = rows.groupBy("asset", "segment").agg(F.count(F.lit(1)).alias("bars"))
    return grid.join(n, ["asset", "segment"])


QUERIES = {
    "quotes_to_bars": (
        lambda s, d: report(rs.quotes_to_bars(quotes(s, d), H4, "bid", "2024-01-02 01:00:00", "2024-01-29 03:00:00")),
        with_views("quotes", f"b AS ({ohlc(H4, 'bid')})", select=f"""SELECT asset, ts, {R4} FROM b
          WHERE ts >= TIMESTAMP '2024-01-02 01:00:00' AND ts + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-29 03:00:00'"""),
    ),
    "signal_bars": (
        lambda s, d: report(rs.signal_bars(quotes(s, d), H4, "mid")),
        with_views("quotes", SIGNAL_4H, select=f"SELECT asset, ts, {R4} FROM sig4"),
    ),
    "bars_rollup_complete": (
        lambda s, d: report(rs.rollup_complete(hourly(s, d), 3600, H4)),
        with_views("quotes", HOURLY, ROLLED, select=f"SELECT asset, ts, {R4} FROM rolled"),
    ),
    "timeframe_options": (
        lambda s, d: rs.timeframe_options(
            quality.bar_frequency(bars(s, d)).unionByName(quality.bar_frequency(hourly(s, d))), quality.TIMEFRAMES),
        with_views("quotes bars", HOURLY, """gaps AS (SELECT asset, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts)) AS BIGINT) AS diff FROM (
            SELECT asset, ts FROM bars UNION ALL SELECT asset, ts FROM hourly)),
          f AS (SELECT asset, diff AS seconds FROM (SELECT asset, diff, row_number() OVER (PARTITION BY asset ORDER BY count(*) DESC, diff) AS k
            FROM gaps WHERE diff IS NOT NULL GROUP BY 1, 2) WHERE k = 1)""",
                   select="""SELECT asset, seconds, timeframe, target FROM f, (VALUES ('1m', 60), ('5m', 300), ('15m', 900), ('30m', 1800), ('1h', 3600), ('4h', 14400), ('1d', 86400)) t(timeframe, target)
          WHERE target >= seconds AND target % seconds = 0"""),
    ),
    "signal_schedule": (
        signal_schedule,
        with_views("quotes", HOURLY, ROLLED, """dec AS (SELECT asset, ts, close, coalesce(CASE WHEN count(*) OVER w = 3 THEN close > avg(close) OVER w END, FALSE) AS entry
            FROM rolled WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 2 PRECEDING))""",
                   select="""SELECT h.asset, h.ts, coalesce(entry, FALSE) AS entry, coalesce(NOT entry, FALSE) AS exit, d.asset IS NOT NULL AS decision, round(d.close, 6) AS signal_price
          FROM hourly h LEFT JOIN dec d ON h.asset = d.asset AND h.ts = d.ts + INTERVAL 3 HOUR"""),
    ),
    "sunday_fold": (
        lambda s, d: report(rs.sunday_fold(bars(s, d))),
        with_views("bars", """m AS (SELECT *, CASE WHEN isodow(ts) = 7 THEN ts + INTERVAL 1 DAY ELSE ts END AS t FROM bars)""",
                   select=f"SELECT asset, ts, {R4} FROM (SELECT asset, t AS ts, arg_min(open, m.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, m.ts) AS close FROM m GROUP BY 1, 2)"),
    ),
    "invert_ohlc": (
        lambda s, d: report(rs.invert_ohlc(bars(s, d)), 9),
        with_views("bars", select="SELECT asset, ts, round(1 / open, 9) AS open, round(1 / low, 9) AS high, round(1 / high, 9) AS low, round(1 / close, 9) AS close FROM bars"),
    ),
    "common_range": (
        common_range,
        with_views("bars", """b AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '1995-01-01' + CAST(substr(asset, 1, 1) AS INTEGER) * INTERVAL 30 DAY),
          r AS (SELECT max(a) AS lo, min(z) AS hi FROM (SELECT min(ts) AS a, max(ts) AS z FROM b GROUP BY asset))""",
                   select="SELECT asset, count(*) AS bars, min(ts) AS first, max(ts) AS last FROM b, r WHERE ts BETWEEN lo AND hi GROUP BY 1"),
    ),
    "grid_sample": (
        lambda s, d: report(rs.grid_sample(quotes(s, d).withColumn("mid", (F.col("bid") + F.col("ask")) / 2), "mid", 3600,
                                           "2024-01-02 00:30:00", "2024-01-29 10:20:00", 10000.0)),
        with_views("quotes", f"""m AS (SELECT asset, ts, sequence, {MID} AS mid FROM quotes WHERE ts >= TIMESTAMP '2024-01-02 00:30:00' AND ts < TIMESTAMP '2024-01-29 10:20:00'),
          g AS (SELECT asset, b AS boundary FROM (SELECT DISTINCT asset FROM quotes), (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 01:00:00', TIMESTAMP '2024-01-29 11:00:00', INTERVAL 1 HOUR)) AS b))""",
                   select="SELECT g.asset, boundary, round(coalesce(mid, 10000e0), 6) AS value FROM g ASOF LEFT JOIN m ON g.asset = m.asset AND g.boundary > m.ts"),
    ),
    "enrich_calendar": (
        lambda s, d: rs.calendar_columns(bars(s, d)).select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "weekday", "month", "day"),
        with_views("bars", select="SELECT asset, ts, CAST(isodow(ts) - 1 AS DOUBLE) AS weekday, CAST(month(ts) AS DOUBLE) AS month, CAST(day(ts) AS DOUBLE) AS day FROM bars"),
    ),
    "stressed_quotes": (
        lambda s, d: report(rs.stressed_quotes(quotes(s, d), 3.0).select("asset", "sequence", "mid", "stressed_bid", "stressed_ask")),
        with_views("quotes", select="SELECT asset, sequence, round((bid + ask) / 2, 6) AS mid, round((bid + ask) / 2 - (ask - bid) / 2 * 3, 6) AS stressed_bid, round((bid + ask) / 2 + (ask - bid) / 2 * 3, 6) AS stressed_ask FROM quotes"),
    ),
    "curve_downsample": (
        curve_downsample,
        with_views("quotes", """c AS (SELECT asset, (bid + ask) / 2 AS equity, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY asset) AS n,
            max((bid + ask) / 2) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM quotes WINDOW w AS (PARTITION BY asset ORDER BY ts, sequence))""",
                   select="""SELECT asset, position, round(equity, 6) AS equity, round(1 - equity / peak, 6) AS drawdown FROM c
          WHERE (asset, position) IN (SELECT (asset, i * (n - 1) // (least(800, n) - 1)) FROM (SELECT DISTINCT asset, n FROM c), range(800) r(i) WHERE i < least(800, n))"""),
    ),
    "cross_market_asof": (cross_market, with_views("bars", select=_cross_sql())),
    "enrich": (
        enriched,
        with_views("bars external", select=_cross_sql(
            ", CAST(isodow(t.ts) - 1 AS DOUBLE) AS weekday, CAST(month(t.ts) AS DOUBLE) AS month, CAST(day(t.ts) AS DOUBLE) AS day,"
            " CASE WHEN e.available_at >= t.ts - INTERVAL 7 DAY THEN round(e.value, 6) END AS external_discount",
            " ASOF LEFT JOIN external e ON t.ts > e.available_at")),
    ),
    "external_asof": (
        external_asof,
        with_views("bars external", select="""SELECT b.asset, b.ts, CASE WHEN e.available_at >= b.ts - INTERVAL 7 DAY THEN round(e.value, 6) END AS external_value,
          CASE WHEN e.available_at >= b.ts - INTERVAL 7 DAY THEN e.available_at END AS external_available_at FROM bars b ASOF LEFT JOIN external e ON b.ts > e.available_at"""),
    ),
    "next_tick_after_close": (
        next_tick,
        with_views("quotes", SIGNAL_4H, select="""SELECT s.asset, s.ts, coalesce(q.sequence, -1) AS tick_sequence, q.ts AS tick_ts FROM (SELECT *, ts + INTERVAL 4 HOUR AS c FROM sig4) s
          ASOF LEFT JOIN quotes q ON s.asset = q.asset AND s.c <= q.ts"""),
    ),
    "latency_fill": (
        latency_fill,
        with_views("quotes", select="""SELECT t.asset, t.sequence, coalesce(q.sequence, -1) AS fill_sequence, round(q.ask, 6) AS fill_ask FROM (SELECT *, ts + INTERVAL 90 SECOND AS r FROM quotes) t
          ASOF LEFT JOIN quotes q ON t.asset = q.asset AND t.r <= q.ts"""),
    ),
    "interval_overlap": (
        interval_overlap,
        """WITH r AS (SELECT o_orderpriority || '/' || year(o_orderdate) || '/' || month(o_orderdate) AS id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
          l AS (SELECT l_shipdate AS s, l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS e, count(*) AS n FROM lineitem GROUP BY 1, 2)
          SELECT id, CAST(coalesce(sum(n), 0) AS BIGINT) AS overlaps, coalesce(sum(n), 0) = 0 AS free FROM r LEFT JOIN l ON l.s <= r.e AND l.e >= r.s GROUP BY 1""",
    ),
    "trace_reconcile": (
        trace_reconcile,
        with_views("bars", RECONCILE, select="SELECT *, FALSE AS passed FROM c"),
    ),
    "segment_split": (
        segment_split,
        with_views("quotes", """sp AS (SELECT asset, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM quotes GROUP BY 1),
          cut AS (SELECT asset, date_trunc('hour', make_timestamp(epoch_us(a) + CAST(floor((epoch_us(b) - epoch_us(a)) * 0.6e0) AS BIGINT))) AS v,
            date_trunc('hour', make_timestamp(epoch_us(a) + CAST(floor((epoch_us(b) - epoch_us(a)) * 0.8e0) AS BIGINT))) AS h FROM sp)""",
                   select="""SELECT asset, CASE WHEN ts < v THEN 'training' WHEN ts < h THEN 'validation' ELSE 'holdout' END AS segment, count(*) AS quotes, min(ts) AS first, max(ts) AS last
          FROM quotes JOIN cut USING (asset) GROUP BY 1, 2"""),
    ),
    "common_partition": (
        lambda s, d: segments.partition_counts(bars(s, d)),
        with_views("bars", """p AS (SELECT max(a) AS a, min(z) AS z FROM (SELECT min(ts) AS a, max(ts) AS z FROM bars GROUP BY asset)),
          q AS (SELECT a, make_timestamp(epoch_us(a) + CAST(floor((epoch_us(z) - epoch_us(a)) * 0.8e0) AS BIGINT)) AS cutoff FROM p),
          r AS (SELECT cutoff, make_timestamp(epoch_us(a) + CAST(floor((epoch_us(cutoff) - epoch_us(a)) * 0.75e0) AS BIGINT)) AS te FROM q)""",
                   select="""SELECT *, training_bars + validation_bars >= 600 AND holdout_bars >= 120 AS enough FROM (SELECT asset, count(*) FILTER (ts < te) AS training_bars,
          count(*) FILTER (ts >= te AND ts < cutoff) AS validation_bars, count(*) FILTER (ts >= cutoff) AS holdout_bars FROM bars, r GROUP BY 1)"""),
    ),
    "first_touch": (
        first_touch,
        with_views("bars", "n AS (SELECT asset, close, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS rn FROM bars)",
                   select="""SELECT e.asset, e.rn AS entry_row, min(x.rn) AS touch_row FROM n e JOIN n x ON e.asset = x.asset AND x.rn > e.rn AND x.rn <= e.rn + 30
          AND (x.close <= e.close * 0.92e0 OR x.close >= e.close * 1.1e0) GROUP BY 1, 2"""),
    ),
    "settings_resolve": (
        settings_resolve,
        """SELECT c_name AS asset, CASE WHEN c_mktsegment = 'BUILDING' THEN 5e0 WHEN c_mktsegment = 'MACHINERY' THEN 3e0 ELSE 2e0 END AS spread_bps,
          CASE WHEN c_acctbal < 0 THEN CAST(c_custkey % 10 AS DOUBLE) WHEN c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 THEN 5e0 ELSE 1e0 END AS slippage_bps, 1e-3 AS commission_rate FROM customer""",
    ),
    "scenario_grid": (
        scenario_grid,
        with_views("bars", """sp AS (SELECT asset, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
          seg AS (SELECT asset, CASE WHEN epoch_us(ts) < epoch_us(a) + CAST(floor((epoch_us(b) - epoch_us(a)) * 0.6e0) AS BIGINT) THEN 'training'
            WHEN epoch_us(ts) < epoch_us(a) + CAST(floor((epoch_us(b) - epoch_us(a)) * 0.8e0) AS BIGINT) THEN 'validation' ELSE 'holdout' END AS segment FROM bars JOIN sp USING (asset))""",
                   select="""SELECT asset, segment, family, fast, slow, cost_multiplier, count(*) AS bars FROM seg, (VALUES ('trend', 5, 20), ('trend', 4, 20), ('dip', 5, 50)) r(family, fast, slow),
          (VALUES (1e0), (2e0), (3e0)) m(cost_multiplier) WHERE segment <> 'holdout' GROUP BY ALL"""),
    ),
}
