"""Registered registries, rule tables, sources and store queries."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.guards import floor_ts, ordered_mean
from ..functions.sampling import draw_sql
from ..operators import quality
from ..operators import registry as rg
from ..plans.inputs import bars, external, quotes, report, table
from ..session import checkpoint_dir
from ..sources import hour_files, payloads, readers, store
from .common import with_views
from .quality_queries import DAY_SQL


def rules(s, d):
    """One rule per part, coarse enough that some repeat."""
    k, z = F.col("p_partkey"), F.col("p_size")
    fam = F.element_at(F.array(*[F.lit(f) for f in rg.FAMILIES]), (k % 8 + 1).cast("int"))
    stop = 0.05 + (z % 3) * 0.01
    return table(s, d, "part").select(
        k.alias("rule"), fam.alias("family"), F.when(k % 3 == 0, "low_volatility").when(k % 3 == 1, "uptrend").otherwise("none").alias("regime"),
        F.when(z % 2 == 0, "strong_close").otherwise("none").alias("confirmation"), (3 + k % 5).cast("double").alias("fast"), (20 + z % 4 * 10).cast("double").alias("slow"),
        (0.5 + (k % 6) / 10).alias("threshold"), F.lit(0.9).alias("allocation"), stop.alias("stop_loss"), (2 * stop).alias("take_profit"), (10 + z % 5).cast("double").alias("max_holding"))


RULES = "rules AS MATERIALIZED (SELECT p_partkey AS rule, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(rg.FAMILIES)) + """ END AS family,
    CASE p_partkey % 3 WHEN 0 THEN 'low_volatility' WHEN 1 THEN 'uptrend' ELSE 'none' END AS regime, CASE WHEN p_size % 2 = 0 THEN 'strong_close' ELSE 'none' END AS confirmation,
    CAST(3 + p_partkey % 5 AS DOUBLE) AS fast, CAST(20 + p_size % 4 * 10 AS DOUBLE) AS slow, 0.5e0 + (p_partkey % 6) / 10 AS threshold, 0.9e0 AS allocation, 5e-2 + (p_size % 3) * 1e-2 AS stop_loss,
    2 * (5e-2 + (p_size % 3) * 1e-2) AS take_profit, CAST(10 + p_size % 5 AS DOUBLE) AS max_holding FROM part)"""
OFF_THRESHOLD = "family IN ('trend', 'ema_trend', 'dip', 'breakout')"
OFF_FAST = "family IN ('breakout', 'momentum', 'mean_reversion', 'volatility_breakout') AND regime <> 'low_volatility'"
GRID = "raw AS (" + " UNION ALL ".join(
    f"SELECT rule, '{n}' AS parameter, {i + 1} AS slot, f AS factor, {n} AS old, fast, slow, " +
    (f"round_even(least({hi}e0, greatest({lo}e0, {n} * f)), 0)" if n in rg.WHOLE else f"round_even(least({hi}::DOUBLE, greatest({lo}::DOUBLE, {n} * f)), 8)") +
    " AS value FROM rules, (VALUES (0.8e0), (1.2e0)) z(f)" +
    (f" WHERE NOT ({OFF_THRESHOLD})" if n == "threshold" else f" WHERE NOT ({OFF_FAST})" if n == "fast" else "")
    for i, (n, (lo, hi)) in enumerate(rg.BOUNDS.items())) + """),
  grid AS MATERIALIZED (SELECT rule, parameter, slot, value, min(factor) AS factor FROM raw WHERE value <> old AND NOT (parameter = 'fast' AND value >= slow) AND NOT (parameter = 'slow' AND value <= fast) GROUP BY 1, 2, 3, 4)"""
JOINT = f"""opts AS (SELECT rule, slot, parameter, list(value ORDER BY value) AS o FROM grid GROUP BY 1, 2, 3),
  moved AS (SELECT rule, t, slot, parameter, o[{draw_sql(43, 'rule', 't', 'slot')} % len(o) + 1] AS value FROM opts, range(80) z(t) WHERE {draw_sql(42, 'rule', 't', 'slot')} % 2 = 1),
  per AS (SELECT rule, t, count(*) AS moved, string_agg(parameter || '=' || CAST(CAST(round(value * 1e6) AS BIGINT) AS VARCHAR), ';' ORDER BY slot) AS changes,
    max(value) FILTER (parameter = 'fast') AS f, max(value) FILTER (parameter = 'slow') AS w FROM moved GROUP BY 1, 2),
  good AS (SELECT rule, changes, min(t) AS "try", min(moved) AS moved FROM per JOIN rules USING (rule) WHERE moved >= 2 AND coalesce(f, fast) < coalesce(w, slow) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY "try") AS k FROM good)"""
FIXED = lambda c: f"CAST(CAST(round({c} * 1e6) AS BIGINT) AS VARCHAR)"


def trials(s, d):
    """Every order as a trial of a structure within a scope."""
    o = table(s, d, "orders")
    return o.select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 50).cast("string")).alias("run"), F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("scope"),
        F.col("o_custkey").cast("string").alias("structure"), (1 + F.col("o_orderkey") % 5).alias("slots"),
        F.when(F.col("o_orderstatus") == "F", "REJECTED").when(F.col("o_orderstatus") == "P", "APPROVED").alias("outcome"),
        F.when(F.col("o_orderstatus") == "F", "TRIAL_RESERVED").when(F.col("o_orderstatus") == "O", "MIGRATION_BASELINE").otherwise("RESEARCH_RESULT").alias("kind"))


TRIALS = """trials AS (SELECT 'run' || (o_custkey % 50) AS run, o_orderkey AS attempt, o_orderpriority AS scope, CAST(o_custkey AS VARCHAR) AS structure, 1 + o_orderkey % 5 AS slots,
    CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'P' THEN 'APPROVED' END AS outcome,
    CASE o_orderstatus WHEN 'F' THEN 'TRIAL_RESERVED' WHEN 'O' THEN 'MIGRATION_BASELINE' ELSE 'RESEARCH_RESULT' END AS kind FROM orders)"""


def audit_log(s, d):
    """The event table as a hash-linked log with some entries tampered with."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    own = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "kind", "payload"), 256)
    from ..operators.blocks import with_previous

    log = with_previous(e.withColumn("event_hash", own), [], ["id"], {"parent": "event_hash"}, slot=F.floor(F.col("id") / 65536))
    log = log.withColumn("payload", F.when(F.col("id") % 397 == 5, F.lit("changed")).otherwise(F.col("payload")))
    return log.withColumn("parent", F.when(F.col("id") % 391 == 7, F.lit("changed")).otherwise(F.col("parent"))).filter(F.col("id") % 383 != 9)


AUDIT = """log0 AS (SELECT *, lag(event_hash) OVER (ORDER BY id) AS parent0 FROM (SELECT event_id AS id, event_type AS kind, props AS payload, sha256(concat_ws('|', event_id::VARCHAR, event_type, props)) AS event_hash FROM events)),
  log AS (SELECT id, kind, CASE WHEN id % 397 = 5 THEN 'changed' ELSE payload END AS payload, CASE WHEN id % 391 = 7 THEN 'changed' ELSE parent0 END AS parent, event_hash FROM log0 WHERE id % 383 <> 9),
  seen AS (SELECT *, lag(event_hash) OVER (ORDER BY id) AS before, sha256(concat_ws('|', id::VARCHAR, kind, payload)) AS own FROM log)"""


def results(s, d):
    """Result rows per customer, from their orders."""
    o = table(s, d, "orders")
    a = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("avg_price"), F.min("o_totalprice").alias("min_price"),
                                   F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("filled"))
    c = table(s, d, "customer").join(a, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.col("c_name").alias("asset"), F.col("c_nationkey").alias("batch"), (F.col("avg_price") / 250000 - 1).alias("net_return"), F.coalesce("filled", F.lit(0)).alias("trades"),
        F.coalesce(F.col("filled") * 2 > F.col("orders"), F.lit(False)).alias("complete"), F.coalesce(F.col("orders") > 10, F.lit(False)).alias("quant_passed"),
        (F.col("c_acctbal") > 5000).alias("stress_passed"), F.coalesce(F.round(F.col("avg_price") / 1e5, 3), F.lit(-1e9)).alias("sharpe"),
        F.coalesce(1 - F.col("min_price") / 5e5, F.lit(1.0)).alias("max_drawdown"))


RESULTS = """a AS (SELECT o_custkey, count(*) AS orders, avg(o_totalprice) AS avg_price, min(o_totalprice) AS min_price, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders GROUP BY 1),
  results AS (SELECT c_name AS asset, c_nationkey AS batch, avg_price / 250000 - 1 AS net_return, coalesce(filled, 0) AS trades, coalesce(filled * 2 > orders, FALSE) AS complete, coalesce(orders > 10, FALSE) AS quant_passed,
    c_acctbal > 5000 AS stress_passed, coalesce(round(avg_price / 1e5, 3), -1e9) AS sharpe, coalesce(1 - min_price / 5e5, 1) AS max_drawdown FROM customer LEFT JOIN a ON c_custkey = o_custkey)"""


def failure_categories(s, d):
    o = table(s, d, "orders")
    p = F.col("o_totalprice")
    reasons = F.array_compact(F.array(
        F.when(p < 20000, F.lit("too_few_trades")), F.when((p > 60000) & (p < 90000), F.lit("cost_stress")), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("parameter_stress")),
        F.when((p > 150000) & (p < 180000), F.lit("walk_forward")), F.when(F.col("o_orderstatus") == "P", F.lit("profit_factor")), F.when(p > 470000, F.lit("benchmark")), F.when(p > 490000, F.lit("unheard of"))))
    rows = o.select("o_orderkey", reasons.alias("reasons"), (F.col("o_custkey") % 3).alias("skipped_orders"), (F.col("o_custkey") % 2).alias("trades"))
    return rg.failure_categories(rows, "o_orderkey").groupBy("category").agg(F.count(F.lit(1)).alias("results"))


FAIL = """r AS (SELECT o_orderkey, 'execution_limits' AS category FROM orders WHERE o_custkey % 3 > 0 AND o_custkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'insufficient_evidence' FROM orders WHERE o_totalprice < 20000
    UNION ALL SELECT o_orderkey, 'costs' FROM orders WHERE o_totalprice > 60000 AND o_totalprice < 90000
    UNION ALL SELECT o_orderkey, 'parameter_fragility' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'instability' FROM orders WHERE o_totalprice > 150000 AND o_totalprice < 180000
    UNION ALL SELECT o_orderkey, 'weak_evidence' FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 470000
    UNION ALL SELECT o_orderkey, 'other' FROM orders WHERE o_totalprice > 490000)"""


def recent_notes(s, d):
    notes = table(s, d, "orders").join(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("run"), (F.col("o_custkey") % 50).cast("string")).alias("run"), F.col("o_orderkey").alias("attempt"), "lines")
    return rg.recent_notes(notes, trials(s, d).filter("outcome IS NOT NULL"))


def scorecard(s, d):
    cand = table(s, d, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_orderpriority").alias("asset"))
    li = table(s, d, "lineitem").select("l_orderkey", "l_shipdate", "l_discount", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))
    res = li.groupBy("l_orderkey").agg(ordered_mean("l_discount", "_place").alias("m"), F.max("l_shipdate").alias("last")).filter("last >= '1999-01-01'").select(
        F.col("l_orderkey").alias("candidate"), (F.col("m") > 0.05).alias("passed"), (F.col("m") * 20).alias("forward_sharpe"))
    return report(rg.scorecard(cand, res))


def holdout_cutoff(s, d):
    li = table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("scope"), F.col("l_shipdate").cast("timestamp").alias("end"))
    return report(rg.holdout_cutoff(table(s, d, "supplier").select(F.col("s_suppkey").alias("scope")), li, "2001-06-01"))


# ---- sources and store ----------------------------------------------------------------------

def quotes_range_read(s, d):
    """Write the quotes as an asset/day store, then read a range of it back."""
    path = f"{checkpoint_dir(s).rstrip('/')}/store-{pd.Timestamp.now().value}"
    q = quotes(s, d)
    store.put_days(s, q, path, "2024-03-01")
    return report(store.read_range(s, path, "2024-01-05 06:00:00", "2024-01-20 18:00:00").select("asset", "ts", "sequence", "bid", "ask"))


def partition_write_plan(s, d):
    q = quotes(s, d)
    existing = q.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")).filter(F.col("asset") < "A5").select("asset", F.to_date("ts").alias("day")).distinct()
    return store.write_plan(q, existing, "2024-01-25 12:00:00").withColumn("day", F.col("day").cast("string"))


def _encode(hour: pa.Table) -> pa.Table:
    """The quotes of one asset's hour as one file."""
    q = hour.sort_by([("ms", "ascending"), ("sequence", "ascending")])
    content = hour_files.encode_hour(q["ms"].to_numpy(), q["bid"].to_numpy(), q["ask"].to_numpy(), 100000.0)
    return hour.select(["asset", "hour"]).slice(0, 1).append_column("scale", pa.array([100000.0])).append_column("content", pa.array([content], pa.binary()))


def hour_file_ingest(s, d):
    """Quotes packed into hourly files, as they would land, and decoded again."""
    q = quotes(s, d).withColumn("hour", floor_ts(F.col("ts"), 3600)).withColumn("ms", F.floor((F.unix_micros("ts") - F.unix_micros("hour")) / 1000))
    files = q.select("asset", "hour", "ms", "sequence", "bid", "ask").groupBy("asset", "hour").applyInArrow(_encode, "asset STRING, hour TIMESTAMP, scale DOUBLE, content BINARY")
    return report(hour_files.decode_hours(files).select("asset", "ts", "sequence", "bid", "ask"))


def delta_candle_decode(s, d):
    """Bars of each asset-year packed as delta arrays, decoded to bars."""
    from pyspark.sql.window import Window

    scale = 1e-5
    b = bars(s, d).withColumn("year", F.year("ts"))
    w = Window.partitionBy("asset", "year").orderBy("ts")
    fields = ("open", "high", "low", "close")
    units = {f"u_{f}": F.round(F.col(f) / scale).cast("long") for f in fields}
    b = b.withColumns(units).withColumn("dt", F.coalesce(F.datediff("ts", F.lag("ts").over(w)), F.lit(0)))
    b = b.withColumns({f"d_{f}": F.col(f"u_{f}") - F.coalesce(F.lag(f"u_{f}").over(w), F.first(f"u_{f}").over(w)) for f in fields})
    entry = F.struct("ts", "dt", *[f"u_{f}" for f in fields], *[f"d_{f}" for f in fields])
    packed = b.groupBy("asset", "year").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    part = lambda n: F.transform("l", lambda e: e[n])
    pay = packed.select("asset", "year", F.unix_millis(F.col("l")[0]["ts"]).alias("base_ms"), F.lit(86_400_000).alias("shift"), F.lit(scale).alias("multiplier"), part("dt").alias("times"),
                        *[(F.col("l")[0][f"u_{f}"] * scale).alias(f) for f in fields], *[part(f"d_{f}").alias(f"{f}s") for f in fields])
    return report(payloads.decode_delta_candles(pay, ["asset", "year"]).drop("year"), 5)


def candle_clip(s, d):
    row = F.array(F.unix_seconds("ts").cast("double"), "low", "high", "open", "close", "volume")
    pay = bars(s, d).groupBy("asset", F.year("ts").alias("year")).agg(F.collect_list(row).alias("candles"))
    return report(payloads.explode_candles(pay, ["asset"], "1996-03-01", "2000-02-15"))


def _documents(s, d):
    """The outside series as one JSON document per year, some of them defective."""
    x = external(s, d).withColumn("y", F.year("available_at"))
    obs = F.array_sort(F.collect_list(F.struct(F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("available_at"), "value")))
    g = x.groupBy("y").agg(obs.alias("o"))
    o = F.when(F.col("y") == 1997, F.concat("o", F.slice("o", 1, 1))).otherwise(F.col("o"))
    doc = F.struct(F.concat(F.lit("discount_"), F.col("y").cast("string")).alias("name"), F.when(F.col("y") == 1998, "http://example.org").otherwise("https://example.org").alias("source_url"),
                   F.when(F.col("y") == 1999, "").otherwise("day after").alias("availability_description"), F.when(F.col("y") == 2000, 0).otherwise(7).alias("max_age_days"), o.alias("observations"))
    return g.select(F.to_json(doc).alias("doc"))


def external_series_load(s, d):
    return payloads.series_problems(payloads.parse_series_documents(_documents(s, d)))


def trace_normalize(s, d):
    n = F.unix_date(F.to_date("ts"))
    raw = bars(s, d).select(
        "asset", F.when(n % 2 == 0, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("signal_timestamp"),
        F.when(n % 3 == 0, "long").when(n % 3 == 1, "short").otherwise("-1").alias("direction"))
    return report(readers.normalize_trace(raw).select("asset", "timestamp", "direction"))


QUERIES = {
    "param_grid": (
        lambda s, d: report(rg.param_grid(rules(s, d), "rule")),
        with_views("", RULES, GRID, select="SELECT rule, parameter, round(value, 6) AS value, factor FROM grid"),
    ),
    "joint_grid": (
        lambda s, d: rg.joint_grid(rules(s, d), "rule"),
        with_views("", RULES, GRID, JOINT, select='SELECT rule, changes, "try", moved FROM ranked WHERE k <= 8'),
    ),
    "rule_dedupe": (
        lambda s, d: rg.rule_dedupe(rules(s, d), "rule"),
        with_views("", RULES, select=f"""SELECT sha256(concat_ws('|', family, regime, confirmation, CASE WHEN {OFF_FAST} THEN '-' ELSE {FIXED('fast')} END, {FIXED('slow')},
          CASE WHEN {OFF_THRESHOLD} THEN '-' ELSE {FIXED('threshold')} END, {FIXED('allocation')}, {FIXED('stop_loss')}, {FIXED('take_profit')}, {FIXED('max_holding')})) AS signature,
          min(rule) AS kept, count(*) AS copies FROM rules GROUP BY 1"""),
    ),
    "variant_grid": (
        lambda s, d: report(rg.variant_grid(table(s, d, "part").select("p_partkey"), "p_partkey")),
        """WITH c AS (SELECT p_partkey, p_partkey // 8 AS cycle, 20 + (p_partkey // 8) * 17 % 131 AS slow FROM part)
          SELECT p_partkey, ['""" + "', '".join(rg.FAMILIES) + """'][p_partkey % 8 + 1] AS family, 2 + (cycle * 7 + 8) % least(39, slow - 2) AS fast, slow, round(0.5e0 + (cycle * 11 % 26) / 10, 6) AS threshold,
          round(0.6e0 + 0.35e0 * list_sum(list_transform(range(40), lambda b: (((cycle + 1) >> b) & 1) / pow(2, b + 1))), 6) AS allocation, round(1e-2 + 5e-3 * (cycle % 20), 6) AS stop_loss,
          round(2 * (1e-2 + 5e-3 * (cycle % 20)), 6) AS take_profit, least(100, greatest(5, slow // 2)) AS max_holding FROM c""",
    ),
    "trial_count": (lambda s, d: rg.trial_count(trials(s, d)), with_views("", TRIALS, select="SELECT CAST(sum(slots) AS BIGINT) AS trials FROM trials WHERE kind <> 'RESEARCH_RESULT'")),
    "trial_budget": (
        lambda s, d: rg.trial_budget(trials(s, d)),
        with_views("", TRIALS, select="""SELECT *, CASE WHEN tried >= 3 THEN 'exhausted' WHEN pending > 0 THEN 'pending_or_approved' ELSE 'open' END AS verdict FROM (
          SELECT scope, structure, count(*) AS tried, count(*) FILTER (coalesce(outcome <> 'REJECTED', TRUE)) AS pending FROM trials GROUP BY 1, 2)"""),
    ),
    "audit_chain_check": (
        lambda s, d: rg.chain_breaks(audit_log(s, d), "id", ["id", "kind", "payload"]),
        with_views("", AUDIT, select="SELECT id, 'content' AS problem FROM seen WHERE event_hash <> own UNION ALL SELECT id, 'parent' FROM seen WHERE coalesce(parent, '') <> coalesce(before, '')"),
    ),
    "failure_categories": (
        failure_categories,
        with_views("", FAIL, select="SELECT category, count(*) AS results FROM r GROUP BY 1"),
    ),
    "asset_verdicts": (
        lambda s, d: rg.asset_verdicts(results(s, d)),
        with_views("", RESULTS, select="""SELECT asset, CASE WHEN net_return IS NULL THEN 'NOT_EVALUATED' WHEN net_return > 0 AND trades > 0 THEN 'POSITIVE' ELSE 'NO_TRADABLE_GAIN' END AS profitability,
          CASE WHEN complete THEN 'PASSED' WHEN net_return IS NOT NULL THEN 'NOT_PASSED' ELSE 'NOT_EVALUATED' END AS robustness FROM results"""),
    ),
    "rank_assets": (
        lambda s, d: report(rg.rank_assets(results(s, d).filter("net_return IS NOT NULL"), ["batch"])),
        with_views("", RESULTS, select="""SELECT batch, selected, round(sharpe, 6) AS sharpe FROM (SELECT batch, asset AS selected, sharpe, row_number() OVER (PARTITION BY batch ORDER BY quant_passed AND stress_passed DESC,
          quant_passed DESC, sharpe DESC, -max_drawdown DESC, net_return DESC, asset DESC) AS k FROM results WHERE net_return IS NOT NULL) WHERE k = 1"""),
    ),
    "recent_notes": (
        recent_notes,
        with_views("", TRIALS, """n AS (SELECT o_orderkey AS id, 'run' || (o_custkey % 50) AS run, o_orderkey AS attempt, lines FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY id DESC LIMIT 12)""",
                   select="SELECT n.*, t.scope FROM n LEFT JOIN trials t ON t.run = n.run AND t.attempt = n.attempt AND t.outcome IS NOT NULL"),
    ),
    "scorecard": (
        scorecard,
        """WITH r AS (SELECT l_orderkey AS candidate, avg(l_discount) > 5e-2 AS passed, avg(l_discount) * 20 AS fs FROM lineitem GROUP BY 1 HAVING max(l_shipdate) >= TIMESTAMP '1999-01-01')
          SELECT o_orderpriority AS asset, count(*) AS frozen, count(passed) AS completed, count(*) - count(passed) AS pending, count(*) FILTER (passed) AS passed, round(avg(fs), 6) AS mean_forward_sharpe
          FROM orders LEFT JOIN r ON candidate = o_orderkey GROUP BY 1""",
    ),
    "holdout_cutoff": (
        holdout_cutoff,
        "SELECT s_suppkey AS scope, greatest(coalesce(max(l_shipdate), TIMESTAMP '2001-06-01'), TIMESTAMP '2001-06-01') AS cutoff FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1",
    ),
    "quotes_range_read": (
        quotes_range_read,
        with_views("quotes", select="SELECT asset, ts, sequence, round(bid, 6) AS bid, round(ask, 6) AS ask FROM quotes WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'"),
    ),
    "partition_write_plan": (
        partition_write_plan,
        with_views("quotes", select="""SELECT asset, CAST(day AS VARCHAR) AS day, ticks, CASE WHEN day >= DATE '2024-01-25' THEN 'incomplete' WHEN day < DATE '2024-01-10' AND asset < 'A5' THEN 'exists' ELSE 'write' END AS action
          FROM (SELECT asset, CAST(ts AS DATE) AS day, count(*) AS ticks FROM quotes GROUP BY 1, 2)"""),
    ),
    "catalog_status": (
        lambda s, d: store.status(quality.quote_day_metrics(quotes(s, d), spread_limit=6.0, gap_limit=8000.0, jump_limit=0.04)),
        with_views("quotes", DAY_SQL, select="""SELECT asset, count(*) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(sum(ticks) AS BIGINT) AS ticks,
          count(*) FILTER (ticks < 2 OR gap_seconds_max > 8000 OR price_jump_max > 4e-2 OR spread_bps_max > 6) AS needs_review FROM days GROUP BY 1"""),
    ),
    "hour_file_ingest": (
        hour_file_ingest,
        with_views("quotes", select="""SELECT asset, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, row_number() OVER (PARTITION BY asset, date_trunc('hour', ts) ORDER BY ts, sequence) - 1 AS sequence,
          round(round_even(bid * 1e5, 0) / 1e5, 6) AS bid, round(round_even(ask * 1e5, 0) / 1e5, 6) AS ask FROM quotes"""),
    ),
    "delta_candle_decode": (
        delta_candle_decode,
        with_views("bars", select="SELECT asset, ts, " + ", ".join(f"round(round({f} / 1e-5) * 1e-5, 5) AS {f}" for f in ("open", "high", "low", "close")) + " FROM bars"),
    ),
    "candle_clip": (
        candle_clip,
        with_views("bars", select="SELECT asset, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '2000-02-15'"),
    ),
    "external_series_load": (
        external_series_load,
        with_views("external", select="""SELECT 'discount_' || y AS name, n + CASE WHEN y = 1997 THEN 1 ELSE 0 END AS observations, CASE y WHEN 1997 THEN 'duplicate_time' WHEN 1998 THEN 'source' WHEN 1999 THEN 'description' WHEN 2000 THEN 'max_age' ELSE '' END AS problems
          FROM (SELECT year(available_at) AS y, count(*) AS n FROM external GROUP BY 1)"""),
    ),
    "trace_normalize": (
        trace_normalize,
        with_views("bars", select="SELECT asset, ts AS timestamp, CASE WHEN date_diff('day', TIMESTAMP '1970-01-01', ts) % 3 = 0 THEN 1 ELSE -1 END AS direction FROM bars"),
    ),
}
