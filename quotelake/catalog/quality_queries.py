"""Registered checks on quotes and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..plans.inputs import bars, quotes, report, table
from .common import with_views

# The requested period of the quote checks and of the bar checks.
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
BAR_START, BAR_END = "1995-01-01 00:00:00", "2001-08-05 00:00:00"


def defective_quotes(spark, d):
    """Quotes in arrival order with known defects worked into some of the rows."""
    e, hit = F.col("sequence"), lambda m, r: F.col("sequence") % m == r
    base = quotes(spark, d)
    edited = base.select(
        "asset",
        (e * 2).alias("arrival"),
        F.when(hit(109, 13), F.lit(None)).when(hit(107, 11), F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")).alias("ts"),
        F.when(hit(127, 3), F.lit(-1)).otherwise(e).alias("sequence"),
        F.when(hit(97, 5), F.col("ask")).when(hit(103, 9), -F.col("bid")).when(hit(101, 7), F.lit(float("nan"))).otherwise(F.col("bid")).alias("bid"),
        F.when(hit(97, 5), F.col("bid")).otherwise(F.col("ask")).alias("ask"),
    )
    copies = base.filter(hit(131, 4)).select("asset", (e * 2 + 1).alias("arrival"), "ts", "sequence", "bid", "ask")
    return edited.unionByName(copies)


DEFECTIVE_QUOTES = """defective AS (
  SELECT asset, sequence * 2 AS arrival,
    CASE WHEN sequence % 109 = 13 THEN NULL WHEN sequence % 107 = 11 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts,
    CASE WHEN sequence % 127 = 3 THEN -1 ELSE sequence END AS sequence,
    CASE WHEN sequence % 97 = 5 THEN ask WHEN sequence % 103 = 9 THEN -bid WHEN sequence % 101 = 7 THEN 'nan'::DOUBLE ELSE bid END AS bid,
    CASE WHEN sequence % 97 = 5 THEN bid ELSE ask END AS ask
  FROM quotes
  UNION ALL SELECT asset, sequence * 2 + 1, ts, sequence, bid, ask FROM quotes WHERE sequence % 131 = 4)"""


def defective_bars(spark, d):
    days = F.unix_date(F.to_date("ts")).cast("long")
    hit = lambda m, r: days % m == r
    base = bars(spark, d)
    edited = base.select(
        "asset", (days * 2).alias("arrival"),
        F.when(hit(89, 4), F.lit(None)).when(hit(83, 7), F.col("ts") - F.expr("INTERVAL 9 DAYS")).otherwise(F.col("ts")).alias("ts"),
        F.when(hit(97, 5), F.lit(None)).otherwise(F.col("open")).alias("open"),
        F.when(hit(61, 5), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(hit(67, 9), F.col("high") + 1).when(hit(71, 9), -F.col("low")).otherwise(F.col("low")).alias("low"),
        "close",
        F.when(hit(59, 2), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        (F.col("open") - 0.01).alias("bid_open"), (F.col("open") + 0.01).alias("ask_open"),
        F.when(hit(53, 6), F.col("close") + 1).otherwise(F.col("close") - 0.01).alias("bid_close"),
        (F.col("close") + 0.01).alias("ask_close"),
        F.when(hit(73, 1), F.lit(None)).when(hit(73, 2), F.lit(-1.0)).otherwise(F.lit(5.0)).alias("spread_bps"),
    )
    extra = ["bid_open", "ask_open", "bid_close", "ask_close"]
    copies = base.filter(hit(79, 3)).select(
        "asset", (days * 2 + 1).alias("arrival"), "ts", "open", "high", "low", "close", "volume",
        *[F.col("close").alias(c) for c in extra], F.lit(5.0).alias("spread_bps"),
    )
    return edited.unionByName(copies)


DEFECTIVE_BARS = """numbered AS (SELECT *, date_diff('day', TIMESTAMP '1970-01-01', ts) AS n FROM bars), defective AS (
  SELECT asset, n * 2 AS arrival,
    CASE WHEN n % 89 = 4 THEN NULL WHEN n % 83 = 7 THEN ts - INTERVAL 9 DAY ELSE ts END AS ts,
    CASE WHEN n % 97 = 5 THEN NULL ELSE open END AS open,
    CASE WHEN n % 61 = 5 THEN low - 1 ELSE high END AS high,
    CASE WHEN n % 67 = 9 THEN high + 1 WHEN n % 71 = 9 THEN -low ELSE low END AS low, close,
    CASE WHEN n % 59 = 2 THEN -volume ELSE volume END AS volume,
    open - 1e-2 AS bid_open, open + 1e-2 AS ask_open,
    CASE WHEN n % 53 = 6 THEN close + 1 ELSE close - 1e-2 END AS bid_close, close + 1e-2 AS ask_close,
    CASE WHEN n % 73 = 1 THEN NULL WHEN n % 73 = 2 THEN -1 ELSE 5 END AS spread_bps
  FROM numbered
  UNION ALL SELECT asset, n * 2 + 1, ts, open, high, low, close, volume, close, close, close, close, 5
  FROM numbered WHERE n % 79 = 3)"""


def _long(checks: dict[str, str], source: str, keep: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {keep}, '{n}' AS reason FROM {source} WHERE {c}" for n, c in checks.items())


DAY_SQL = """lagged AS (
  SELECT *, CAST(ts AS DATE) AS day, (bid + ask) / 2 AS mid,
    lag(ts) OVER w AS pts, lag((bid + ask) / 2) OVER w AS pmid
  FROM quotes WINDOW w AS (PARTITION BY asset, CAST(ts AS DATE) ORDER BY ts, sequence)),
days AS (
  SELECT asset, day, count(*) AS ticks,
    CASE WHEN count(*) > 1 THEN max((ask - bid) / mid * 10000) END AS spread_bps_max,
    CASE WHEN count(*) > 1 THEN quantile_cont((ask - bid) / mid * 10000, 0.99) END AS spread_bps_p99,
    CASE WHEN count(*) > 1 THEN max((epoch_us(ts) - epoch_us(pts)) / 1e6) END AS gap_seconds_max,
    CASE WHEN count(*) > 1 THEN max(abs(mid / pmid - 1)) END AS price_jump_max,
    count(*) - count(DISTINCT (ts, bid, ask)) AS repeated_quotes
  FROM lagged GROUP BY 1, 2)"""


def quote_day_quality(spark, d):
    days = q.quote_day_metrics(quotes(spark, d)).withColumn("issues", F.concat_ws(",", F.array_sort("issues")))
    return report(days.withColumn("day", F.col("day").cast("string")))


def _graded(spark, d):
    return q.quote_day_metrics(quotes(spark, d), spread_limit=6.0, gap_limit=8000.0, jump_limit=0.04)


def grid_alignment(spark, d):
    # Bars whose time was moved off the daily grid on some days.
    n = F.unix_date(F.to_date("ts"))
    moved = bars(spark, d).withColumn(
        "ts", F.when(n % 43 == 5, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    )
    return report(q.grid_alignment(moved, 86400, BAR_END))


def _contracts(spark, d):
    """Two versions of the contract table: as declared and as a request restates it."""
    s = table(spark, d, "supplier")
    base = s.select(
        F.col("s_name").alias("instrument"),
        F.concat(F.lit("venue "), (F.col("s_nationkey") % 3).cast("string")).alias("source"),
        F.when(F.col("s_nationkey") % 7 == 0, F.lit(None)).otherwise(F.lit("USD")).alias("quote_currency"),
        F.lit("1d").alias("timeframe"),
        F.round(F.col("s_acctbal") / 1e6, 6).alias("commission_rate"),
        F.col("s_suppkey").alias("k"),
    )
    asked = base.select(
        "instrument",
        F.when(F.col("k") % 5 == 1, F.lit("other")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("k") % 7 == 2, F.lit("EUR")).otherwise(F.col("quote_currency")).alias("quote_currency"),
        F.when(F.col("k") % 11 == 3, F.lit("1h")).otherwise(F.col("timeframe")).alias("timeframe"),
        (F.col("commission_rate") + F.when(F.col("k") % 13 == 4, 0.001).otherwise(0.0)).alias("commission_rate"),
    )
    return base.filter(F.col("k") % 17 != 6).drop("k"), asked


def contract_mismatch(spark, d):
    declared, asked = _contracts(spark, d)
    return q.contract_mismatch(declared, asked, "instrument", ["source", "quote_currency", "timeframe", "commission_rate"])


def coverage_check(spark, d):
    rows = quotes(spark, d)
    contracts = rows.select("asset").distinct().select(
        "asset",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.substring("asset", 2, 1).cast("int"))).alias("coverage_start"),
        F.lit("2024-01-30").cast("timestamp").alias("coverage_end"),
        F.lit("2024-01-03").cast("timestamp").alias("request_start"),
        F.lit("2024-01-29").cast("timestamp").alias("request_end"),
    )
    return q.coverage_check(rows, contracts, "2024-01-30 12:00:00")


def dataset_fingerprint(spark, d):
    text = F.concat_ws("|", "asset", F.unix_micros("ts").cast("string"), F.col("sequence").cast("string"),
                       F.round(F.col("bid") * 1e6).cast("long").cast("string"), F.round(F.col("ask") * 1e6).cast("long").cast("string"))
    rows = quotes(spark, d).withColumn("day", F.to_date("ts").cast("string"))
    return q.fingerprint(rows, ["asset", "day"], text)


def field_gaps(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("asset"), F.col("event_type").alias("field"))
    return q.field_gaps(e, "asset", "field", ["click", "error", "purchase", "refund", "view"])


SETTINGS_SQL = """settings AS (
  SELECT DISTINCT asset, CASE WHEN asset LIKE '1%' THEN 1e-3 ELSE 35e-6 END AS commission_rate,
    CASE WHEN asset LIKE '2%' THEN 1e0 ELSE 0e0 END AS fixed_commission,
    CASE WHEN asset LIKE '3%' THEN 10e0 ELSE 5e0 END AS min_notional,
    CASE WHEN asset LIKE '5%' THEN 1e3 ELSE 1e0 END AS quantity_step FROM bars)"""


def _settings(b):
    a = F.substring("asset", 1, 1)
    return b.select("asset").distinct().select(
        "asset",
        F.when(a == "1", 1e-3).otherwise(35e-6).alias("commission_rate"),
        F.when(a == "2", 1.0).otherwise(0.0).alias("fixed_commission"),
        F.when(a == "3", 10.0).otherwise(5.0).alias("min_notional"),
        F.when(a == "5", 1e3).otherwise(1.0).alias("quantity_step"),
    )


def affordability(spark, d):
    b = bars(spark, d)
    return report(q.affordability(b, _settings(b), 10000.0, 0.9))


QUERIES = {
    "quote_violations": (
        lambda s, d: q.quote_violations(defective_quotes(s, d)),
        with_views("quotes", DEFECTIVE_QUOTES, """seen AS (
          SELECT *, lag(ts) OVER w AS pts, lag(sequence) OVER w AS pseq FROM defective WINDOW w AS (PARTITION BY asset ORDER BY arrival))""",
                   select=_long({
                       "missing_time": "ts IS NULL", "bad_sequence": "sequence IS NULL OR sequence < 0",
                       "time_backwards": "ts < pts", "sequence_not_increasing": "ts = pts AND sequence <= pseq",
                       "not_finite": "NOT isfinite(bid) OR NOT isfinite(ask)", "not_positive": "bid <= 0 OR ask <= 0",
                       "crossed": "bid > ask AND NOT isnan(bid)"}, "seen", "asset, arrival")),
    ),
    "bar_violations": (
        lambda s, d: q.bar_violations(defective_bars(s, d)),
        with_views("bars", DEFECTIVE_BARS, """seen AS (
          SELECT *, lag(ts) OVER (PARTITION BY asset ORDER BY arrival) AS pts FROM defective)""",
                   select=_long({
                       "missing_time": "ts IS NULL", "duplicate_time": "ts = pts", "time_backwards": "ts < pts",
                       "not_finite": "open IS NULL", "not_positive": "least(open, high, low, close) <= 0",
                       "high_too_low": "high < greatest(open, high, low, close)", "low_too_high": "low > least(open, high, low, close)",
                       "negative_volume": "volume < 0",
                       "bad_observed_quotes": "bid_open IS NULL OR ask_open < bid_open OR ask_close < bid_close",
                       "bad_spread_bps": "spread_bps IS NULL OR spread_bps < 0"}, "seen", "asset, arrival")
                   + "\nUNION ALL SELECT asset, NULL, 'too_few_bars' FROM defective GROUP BY asset HAVING count(*) < 600"),
    ),
    "quote_day_quality": (
        quote_day_quality,
        with_views("quotes", DAY_SQL, select="""
          SELECT asset, CAST(day AS VARCHAR) AS day, ticks, round(spread_bps_max, 6) AS spread_bps_max, round(spread_bps_p99, 6) AS spread_bps_p99,
            round(gap_seconds_max, 6) AS gap_seconds_max, round(price_jump_max, 6) AS price_jump_max, repeated_quotes,
            concat_ws(',', CASE WHEN ticks < 2 THEN 'fewer_than_two_ticks' END, CASE WHEN gap_seconds_max > 300 THEN 'gap' END,
              CASE WHEN price_jump_max > 2e-2 THEN 'jump' END, CASE WHEN spread_bps_max > 50 THEN 'spread' END) AS issues,
            CASE WHEN ticks < 2 OR gap_seconds_max > 300 OR price_jump_max > 2e-2 OR spread_bps_max > 50 THEN 'NEEDS_REVIEW' ELSE 'PASSED' END AS status
          FROM days"""),
    ),
    "weekend_hours": (
        lambda s, d: q.weekend_hours(quotes(s, d)),
        with_views("quotes", select="""SELECT asset, closed, count(*) AS hours, CAST(sum(n) AS BIGINT) AS ticks FROM (
          SELECT asset, isodow(h) = 6 OR (isodow(h) = 7 AND hour(h) < 20) OR (isodow(h) = 5 AND hour(h) >= 23) AS closed, n FROM (
            SELECT asset, date_trunc('hour', ts) AS h, count(*) AS n FROM quotes GROUP BY 1, 2)) GROUP BY 1, 2"""),
    ),
    "hour_coverage": (
        lambda s, d: report(q.hour_coverage(quotes(s, d), "2024-01-01", "2024-01-31").withColumn("day", F.col("day").cast("string"))),
        with_views("quotes", """grid AS (
          SELECT asset, h FROM (SELECT DISTINCT asset FROM quotes), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00', INTERVAL 1 HOUR)) AS h)),
          marked AS (SELECT g.asset, g.h, isodow(h) = 6 OR (isodow(h) = 7 AND hour(h) < 20) OR (isodow(h) = 5 AND hour(h) >= 23) AS closed, n
            FROM grid g LEFT JOIN (SELECT asset, date_trunc('hour', ts) AS h, count(*) AS n FROM quotes GROUP BY 1, 2) USING (asset, h))""",
                   select="""SELECT asset, CAST(CAST(h AS DATE) AS VARCHAR) AS day, count(*) FILTER (NOT closed) AS expected_hours,
            count(*) FILTER (NOT closed AND n IS NOT NULL) AS present_hours, count(*) FILTER (closed) AS closed_hours,
            coalesce(string_agg(strftime(h, '%H'), ',' ORDER BY h) FILTER (NOT closed AND n IS NULL), '') AS missing
          FROM marked GROUP BY 1, 2"""),
    ),
    "missing_days": (
        lambda s, d: q.missing_days(
            quotes(s, d).groupBy("asset", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 42"),
            "2023-12-25", "2024-02-05").withColumn("day", F.col("day").cast("string")),
        with_views("quotes", select="""SELECT asset, CAST(CAST(day AS DATE) AS VARCHAR) AS day FROM (SELECT DISTINCT asset FROM quotes),
          (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS day)
          WHERE (asset, CAST(day AS DATE)) NOT IN (SELECT (asset, CAST(ts AS DATE)) FROM quotes GROUP BY asset, CAST(ts AS DATE) HAVING count(*) >= 42)"""),
    ),
    "quality_gate": (
        lambda s, d: q.quality_gate(_graded(s, d)),
        with_views("quotes", DAY_SQL, """graded AS (SELECT asset, day, ticks < 2 OR gap_seconds_max > 8000 OR price_jump_max > 4e-2 OR spread_bps_max > 6 AS bad FROM days)""",
                   select="""SELECT asset, count(*) AS days, count(*) FILTER (bad) AS blocked_days,
          CAST(min(day) FILTER (bad) AS VARCHAR) AS first_blocked, count(*) FILTER (bad) = 0 AS readable FROM graded GROUP BY 1"""),
    ),
    "bar_frequency": (
        lambda s, d: q.bar_frequency(bars(s, d)),
        with_views("bars", """gaps AS (SELECT asset, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts)) AS BIGINT) AS diff FROM bars)""",
                   select="""SELECT asset, diff AS seconds, diff IN (60, 300, 900, 1800, 3600, 14400, 86400) AS known FROM (
          SELECT asset, diff, row_number() OVER (PARTITION BY asset ORDER BY count(*) DESC, diff) AS k FROM gaps WHERE diff IS NOT NULL GROUP BY 1, 2) WHERE k = 1"""),
    ),
    "grid_alignment": (
        grid_alignment,
        with_views("bars", """moved AS (SELECT asset, CASE WHEN date_diff('day', TIMESTAMP '1970-01-01', ts) % 43 = 5 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts FROM bars),
          gaps AS (SELECT asset, ts, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts)) AS BIGINT) AS diff FROM moved),
          modal AS (SELECT asset, diff FROM (SELECT asset, diff, row_number() OVER (PARTITION BY asset ORDER BY count(*) DESC, diff) AS k FROM gaps WHERE diff IS NOT NULL GROUP BY 1, 2) WHERE k = 1)""",
                   select=f"""SELECT g.asset, count(*) FILTER (CAST(epoch(ts) AS BIGINT) % 86400 <> 0) AS off_grid, count(*) FILTER (g.diff % 86400 <> 0) AS off_step,
          first(m.diff) = 86400 AS step_as_declared, max(ts) + INTERVAL 1 DAY <= TIMESTAMP '{BAR_END}' AS last_closed
          FROM gaps g JOIN modal m USING (asset) GROUP BY 1"""),
    ),
    "bar_coverage": (
        lambda s, d: report(q.bar_coverage(bars(s, d), BAR_START, BAR_END)),
        with_views("bars", """gaps AS (SELECT asset, ts, floor((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY asset ORDER BY ts))) / 86400) AS g FROM bars)""",
                   select=f"""SELECT *, gap_days <= 7 AND late_days <= 7 AND stale_days <= 7 AS covered FROM (
          SELECT asset, min(ts) AS first, max(ts) AS last, CAST(max(g) AS BIGINT) AS gap_days,
            CAST(floor((epoch(min(ts)) - epoch(TIMESTAMP '{BAR_START}')) / 86400) AS BIGINT) AS late_days,
            CAST(floor((epoch(TIMESTAMP '{BAR_END}') - epoch(max(ts))) / 86400) AS BIGINT) AS stale_days FROM gaps GROUP BY 1)"""),
    ),
    "quote_gaps": (
        lambda s, d: q.quote_gaps(quotes(s, d), START, END, 18_000_000),
        with_views("quotes", select=f"""SELECT asset, gap_us, gap_us <= 18000000000 AS passed FROM (
          SELECT asset, greatest(max(g), epoch_us(TIMESTAMP '{END}') - max(epoch_us(ts))) AS gap_us FROM (
            SELECT asset, ts, epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER (PARTITION BY asset ORDER BY ts, sequence)), epoch_us(TIMESTAMP '{START}')) AS g
            FROM quotes WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}') GROUP BY 1)"""),
    ),
    "coverage_check": (
        coverage_check,
        with_views("quotes", """c AS (SELECT *, TIMESTAMP '2024-01-01' + CAST(substr(asset, 2, 1) AS INTEGER) * INTERVAL 1 DAY AS s, TIMESTAMP '2024-01-30' AS e FROM quotes)""",
                   select="""SELECT asset, count(*) FILTER (ts < s OR ts >= e) AS rows_outside, count(*) FILTER (ts > TIMESTAMP '2024-01-30 12:00:00') AS rows_in_future,
          first(s <= TIMESTAMP '2024-01-03' AND e >= TIMESTAMP '2024-01-29') AS request_covered FROM c GROUP BY 1"""),
    ),
    "contract_mismatch": (
        contract_mismatch,
        with_views("", """base AS (SELECT s_name AS instrument, 'venue ' || (s_nationkey % 3) AS source, CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE 'USD' END AS cur,
            '1d' AS tf, round(s_acctbal / 1e6, 6) AS com, s_suppkey AS k FROM supplier),
          asked AS (SELECT instrument, CASE WHEN k % 5 = 1 THEN 'other' ELSE source END AS source, CASE WHEN k % 7 = 2 THEN 'EUR' ELSE cur END AS cur,
            CASE WHEN k % 11 = 3 THEN '1h' ELSE tf END AS tf, com + CASE WHEN k % 13 = 4 THEN 1e-3 ELSE 0e0 END AS com FROM base)""",
                   select="""SELECT * FROM (SELECT a.instrument, CASE WHEN b.instrument IS NULL THEN 'absent' ELSE concat_ws(',',
            CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.cur IS DISTINCT FROM b.cur THEN 'quote_currency' END,
            CASE WHEN a.tf IS DISTINCT FROM b.tf THEN 'timeframe' END, CASE WHEN a.com IS DISTINCT FROM b.com THEN 'commission_rate' END) END AS mismatch
          FROM asked a LEFT JOIN (SELECT * FROM base WHERE k % 17 <> 6) b USING (instrument)) WHERE mismatch <> ''"""),
    ),
    "dataset_fingerprint": (
        dataset_fingerprint,
        with_views("quotes", """hashed AS (SELECT asset, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sha256(concat_ws('|', asset, epoch_us(ts)::VARCHAR, sequence::VARCHAR,
            round(bid * 1e6)::BIGINT::VARCHAR, round(ask * 1e6)::BIGINT::VARCHAR)) AS h FROM quotes)""",
                   select="""SELECT asset, day, count(*) AS rows, sha256(concat_ws('|', count(*)::VARCHAR, sum(('0x' || h[1:15])::BIGINT)::VARCHAR,
          sum(('0x' || h[16:30])::BIGINT)::VARCHAR, sum(('0x' || h[31:45])::BIGINT)::VARCHAR, sum(('0x' || h[46:60])::BIGINT)::VARCHAR)) AS sha256 FROM hashed GROUP BY 1, 2"""),
    ),
    "field_gaps": (
        field_gaps,
        """SELECT CAST(user_id AS VARCHAR) AS asset, concat_ws(',', CASE WHEN NOT bool_or(event_type = 'click') THEN 'click' END, CASE WHEN NOT bool_or(event_type = 'error') THEN 'error' END,
          CASE WHEN NOT bool_or(event_type = 'purchase') THEN 'purchase' END, CASE WHEN NOT bool_or(event_type = 'refund') THEN 'refund' END,
          CASE WHEN NOT bool_or(event_type = 'view') THEN 'view' END) AS missing FROM events GROUP BY 1""",
    ),
    "column_catalogue": (
        lambda s, d: report(q.column_catalogue(
            bars(s, d).withColumn("inverse_excess", F.lit(1.0) / F.nullif(F.col("volume") - 1, F.lit(0.0))),
            ["open", "high", "low", "close", "volume", "inverse_excess"])),
        with_views("bars", """long AS (UNPIVOT (SELECT asset, ts, open, high, low, close, volume, coalesce(1 / nullif(volume - 1, 0), 'nan'::DOUBLE) AS inverse_excess FROM bars)
          ON open, high, low, close, volume, inverse_excess INTO NAME col VALUE v)""",
                   select="""SELECT asset, col AS "column", count(*) FILTER (NOT isnan(v)) AS observations, round(count(*) FILTER (NOT isnan(v)) / count(*), 6) AS coverage,
          round(avg(v) FILTER (NOT isnan(v)), 6) AS mean, round(stddev_samp(v) FILTER (NOT isnan(v)), 6) AS std FROM long GROUP BY 1, 2"""),
    ),
    "affordability": (
        affordability,
        with_views("bars", SETTINGS_SQL, select="""SELECT asset, round(need, 6) AS required, 9000 >= need AS affordable FROM (
          SELECT b.asset, greatest(first(min_notional), first(quantity_step) * min(open)) * (1 + first(commission_rate)) + first(fixed_commission) AS need
          FROM bars b JOIN settings USING (asset) GROUP BY 1)"""),
    ),
}
