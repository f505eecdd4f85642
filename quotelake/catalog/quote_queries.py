"""Registered orders, trades, events and equity on quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ta
from ..operators import quote_ledger as ql
from ..operators import resample as rs
from ..operators.metrics import running_peak
from ..plans.inputs import quotes, report
from .common import with_views
from .time_queries import H4, SIGNAL_4H

KEYS = ["asset"]
MARKET = ql.Terms(latency_ms=1_000_000, order_ttl_ms=14_400_000, distance_unit="percent", stop_loss=0.004, take_profit=0.006, max_holding=86_400_000,
                  commission_rate=1e-4, fixed_commission=0.5, slippage_bps=1.0, holding_cost_bps=1.0)
LIMIT = ql.Terms(direction=-1, latency_ms=1_000_000, order_ttl_ms=28_800_000, distance_unit="percent", stop_loss=0.02, take_profit=0.008, max_holding=6, holding_unit="events",
                 entry_limit_offset=0.003, target_limit=True, commission_rate=1e-4, fixed_commission=0.5, slippage_bps=1.0, holding_cost_bps=1.0, cost_multiplier=2.0)
PASSIVE = ql.Terms(latency_ms=1_000_000, order_ttl_ms=14_400_000, protected=False, commission_rate=1e-4, fixed_commission=0.5, slippage_bps=1.0, holding_cost_bps=1.0)


def rule(bars):
    c = ta.number("close")
    return ta.evaluate(bars, {"entry": ta.signal(c > ta.sma(c, 3)), "exit": ta.signal(c < 0.995 * ta.sma(c, 3))}, KEYS, ["ts"])


def decided(s, d):
    return ql.signal_quotes(quotes(s, d), H4, "mid", rule)


DECIDED = """dec0 AS (SELECT asset, ts + INTERVAL 4 HOUR AS closes, coalesce(CASE WHEN count(*) OVER w = 3 THEN close > avg(close) OVER w END, FALSE) AS entry,
    coalesce(CASE WHEN count(*) OVER w = 3 THEN close < 0.995e0 * avg(close) OVER w END, FALSE) AS exit FROM sig4 WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 2 PRECEDING)),
  dec AS (SELECT asset, sequence, arg_max(entry, closes) AS entry, arg_max(exit, closes) AS exit FROM (SELECT d.asset, q.sequence, d.entry, d.exit, d.closes FROM dec0 d ASOF JOIN quotes q ON d.asset = q.asset AND d.closes <= q.ts) GROUP BY 1, 2)"""


def rows_sql(t: ql.Terms, decided_by: str = "dec") -> str:
    buy, sell = f"sa * (1 + {t.slip!r}::DOUBLE)", f"sb * (1 - {t.slip!r}::DOUBLE)"
    op, cp, liq = (buy, sell, "sb") if t.direction > 0 else (sell, buy, "sa")
    return f"""q0 AS (SELECT quotes.*, row_number() OVER w - 1 AS rn, (bid + ask) / 2 AS mid, (bid + ask) / 2 - (ask - bid) / 2 * {t.cost_multiplier} AS sb, (bid + ask) / 2 + (ask - bid) / 2 * {t.cost_multiplier} AS sa,
    coalesce(d.entry, FALSE) AS entry, coalesce(d.exit, FALSE) AS exit, CASE WHEN d.asset IS NULL THEN 0 ELSE 1 END AS decision FROM quotes LEFT JOIN {decided_by} d USING (asset, sequence) WINDOW w AS (PARTITION BY asset ORDER BY ts, sequence)),
  q AS MATERIALIZED (SELECT asset, ts, sequence, rn, entry, exit, sb, sa, {op} AS op, {cp} AS cp, {liq} AS liq, sum(decision) OVER (PARTITION BY asset ORDER BY rn) AS age,
    sum(step) OVER (PARTITION BY asset ORDER BY rn) AS carry FROM (SELECT *, coalesce(lag(mid) OVER w * {t.holding_cost_bps} / 1e4 * {t.cost_multiplier} * ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400e6), 0) AS step FROM q0 WINDOW w AS (PARTITION BY asset ORDER BY rn))),
  fin AS (SELECT asset, max(rn) AS last FROM q GROUP BY 1)"""


def courses_sql(t: ql.Terms) -> str:
    us = lambda ms: f"{ms * 1000}"
    ref = "sa" if t.direction > 0 else "sb"
    lim = f"c.{ref} - {t.direction} * c.{ref} * {t.entry_limit_offset}::DOUBLE" if t.entry_limit_offset is not None else None
    ok = f"AND {t.direction} * (q.op - ({lim})) <= 0" if lim else ""
    gain = "q.cp" if t.target_limit else "q.liq"
    stop, target = f"f.ep - {t.direction} * f.ep * {t.stop_loss}::DOUBLE", f"f.ep + {t.direction} * f.ep * {t.take_profit}::DOUBLE"
    timed = f"epoch_us(q.ts) >= epoch_us(f.fts) + {us(t.max_holding)}" if t.holding_unit == "milliseconds" else f"q.age >= f.fage + {t.max_holding}"
    prot = "TRUE" if t.protected else "FALSE"
    return f"""c0 AS (SELECT c.asset, c.rn, c.ts, {lim or 'NULL::DOUBLE'} AS lim, min(q.rn) FILTER (epoch_us(q.ts) >= epoch_us(c.ts) + {us(t.order_ttl_ms)}) AS kx, min(q.rn) FILTER (q.exit) AS ke,
      min(q.rn) FILTER (epoch_us(q.ts) >= epoch_us(c.ts) + {us(t.latency_ms)} {ok}) AS fill FROM q c LEFT JOIN q ON q.asset = c.asset AND q.rn > c.rn WHERE c.entry AND NOT c.exit GROUP BY ALL),
  c1 AS MATERIALIZED (SELECT *, least(kx, ke) AS cancel, CASE WHEN least(kx, ke) IS NOT NULL AND (fill IS NULL OR least(kx, ke) <= fill) THEN 'cancelled' WHEN fill IS NULL THEN 'pending' ELSE 'filled' END AS outcome FROM c0),
  f AS (SELECT c1.asset, c1.rn, fill, q.ts AS fts, q.op AS ep, q.age AS fage, q.carry AS fc, q.sequence AS fs FROM c1 JOIN q ON q.asset = c1.asset AND q.rn = c1.fill WHERE outcome = 'filled'),
  g0 AS (SELECT f.asset, f.rn, f.ep, min(q.rn) FILTER ({prot} AND {t.direction} * (q.liq - ({stop})) <= 0) AS ks, min(q.rn) FILTER ({prot} AND {t.direction} * ({gain} - ({target})) >= 0 AND NOT {t.direction} * (q.liq - ({stop})) <= 0) AS kt,
      min(q.rn) FILTER (q.exit) AS ke, min(q.rn) FILTER ({prot} AND {timed}) AS km FROM f JOIN q ON q.asset = f.asset AND q.rn >= f.fill GROUP BY ALL),
  g AS (SELECT *, least(ks, kt, ke, km) AS trig, CASE WHEN least(ks, kt) <= coalesce(least(ke, km), least(ks, kt)) THEN CASE WHEN ks <= coalesce(kt, ks) THEN 'stop' ELSE '{'target_limit' if t.target_limit else 'target'}' END
      WHEN ke <= coalesce(km, ke) THEN 'condition' WHEN km IS NOT NULL THEN 'max_holding' END AS reason FROM g0),
  h0 AS (SELECT g.asset, g.rn, trig, reason, min(x.rn) FILTER (epoch_us(x.ts) >= epoch_us(t.ts) + {us(t.latency_ms)}) AS mx
      FROM g LEFT JOIN q t ON t.asset = g.asset AND t.rn = g.trig LEFT JOIN q x ON x.asset = g.asset AND x.rn > g.trig GROUP BY 1, 2, 3, 4),
  h AS (SELECT asset, rn, trig, reason, CASE WHEN reason = 'target_limit' THEN trig ELSE mx END AS x0 FROM h0),
  c AS MATERIALIZED (SELECT c1.asset, c1.rn, c1.ts, c1.lim, c1.cancel, c1.kx, c1.fill, c1.outcome, fin.last, f.fts, f.ep, f.fc, f.fs, {stop} AS stop, {target} AS target, h.trig, h.reason, coalesce(h.x0, fin.last) AS xrow,
      CASE WHEN h.x0 IS NULL THEN 'segment_end' ELSE h.reason END AS xreason, x.ts AS xts, x.cp AS xp, x.carry - f.fc AS uc, x.sequence AS xs,
      CASE outcome WHEN 'cancelled' THEN c1.cancel WHEN 'pending' THEN fin.last ELSE coalesce(h.x0, fin.last) END AS nextat
    FROM c1 JOIN fin USING (asset) LEFT JOIN f ON f.asset = c1.asset AND f.rn = c1.rn LEFT JOIN h ON h.asset = c1.asset AND h.rn = c1.rn LEFT JOIN q x ON x.asset = c1.asset AND x.rn = coalesce(h.x0, fin.last) AND outcome = 'filled')"""


def walk_sql(t: ql.Terms) -> str:
    rate, fixed, d = f"{t.rate!r}::DOUBLE", f"{t.fixed!r}::DOUBLE", t.direction
    fits = f"outcome = 'filled' AND qty > 0 AND qty * ep >= {t.min_notional}"
    fee, leave = f"(qty * ep * {rate} + {fixed})", f"(qty * xp * {rate} + {fixed})"
    return f"""hop AS MATERIALIZED (SELECT o.asset, o.at, min(c.rn) AS nx FROM (SELECT asset, nextat AS at FROM c UNION SELECT asset, fill FROM c WHERE fill IS NOT NULL UNION SELECT asset, -1 FROM fin) o LEFT JOIN c ON c.asset = o.asset AND c.rn > o.at GROUP BY 1, 2),
  walk AS (SELECT asset, CAST(-1 AS BIGINT) AS at, {t.capital}::DOUBLE AS cash, 'start' AS result, CAST(-1 AS BIGINT) AS rn, 0e0 AS qty, 0e0 AS pnl, 0e0 AS opened FROM fin
    UNION ALL SELECT asset, CASE WHEN {fits} OR outcome <> 'filled' THEN nextat ELSE fill END, CASE WHEN {fits} THEN cash - ({d} * qty * ep + {fee}) - qty * uc + {d} * (qty * xp) - {leave} ELSE cash END,
      CASE WHEN {fits} THEN 'trade' WHEN outcome = 'filled' THEN 'rejected' ELSE outcome END, rn, coalesce(qty, 0), CASE WHEN {fits} THEN {d} * qty * (xp - ep) - {fee} - qty * uc - {leave} END, CASE WHEN {fits} THEN cash - ({d} * qty * ep + {fee}) END
    FROM (SELECT c.*, w.cash, floor(greatest(0, (w.cash * {t.allocation}::DOUBLE - {fixed}) / (c.ep * (1 + {rate}))) / {t.quantity_step!r}::DOUBLE) * {t.quantity_step!r}::DOUBLE AS qty
      FROM walk w JOIN hop h ON h.asset = w.asset AND h.at = w.at JOIN c ON c.asset = h.asset AND c.rn = h.nx WHERE w.cash > 0)),
  book AS (SELECT w.result, w.qty, w.pnl, w.opened, w.cash, c.* FROM walk w JOIN c USING (asset, rn) WHERE result <> 'start'),
  deal AS (SELECT * FROM book WHERE result = 'trade')"""


def marks_sql(t: ql.Terms) -> str:
    return f"""marks AS (SELECT q.asset, q.rn, q.ts, q.rn < d.xrow AS held, CASE WHEN d.fill IS NULL THEN {t.capital}::DOUBLE WHEN q.rn < d.xrow THEN d.opened - d.qty * (q.carry - d.fc) + {t.direction} * d.qty * q.cp - d.qty * q.cp * {t.rate!r}::DOUBLE - {t.fixed!r}::DOUBLE ELSE d.cash END AS value
    FROM q ASOF LEFT JOIN deal d ON q.asset = d.asset AND q.rn >= d.fill)"""


def sql(t: ql.Terms, select: str, *more: str) -> str:
    return with_views("quotes", SIGNAL_4H, DECIDED, rows_sql(t), courses_sql(t), walk_sql(t), *more, select=select)


def courses(s, d, t):
    from ..session import stage

    return ql.order_courses(stage(ql.quote_rows(decided(s, d), KEYS, t)), KEYS, t)


def trades(s, d, t):
    _, book, _ = ql.run_quotes(decided(s, d), KEYS, t)
    return report(book.filter("result = 'trade'").select("asset", "entry_sequence", "exit_sequence", "fill_ts", "exit_ts", "quantity", "entry_price", "exit_price", "pnl", "exit_reason"))


TRADES = """SELECT asset, fs AS entry_sequence, xs AS exit_sequence, fts AS fill_ts, xts AS exit_ts, round(qty, 6) AS quantity, round(ep, 6) AS entry_price, round(xp, 6) AS exit_price, round(pnl, 6) AS pnl, xreason AS exit_reason FROM deal"""


def quote_equity(s, d):
    _, _, marks = ql.run_quotes(decided(s, d), KEYS, MARKET)
    return report(rs.grid_sample(marks, "value", 3600, "2024-01-01", "2024-01-31", MARKET.capital))


def quote_metrics(s, d):
    t = MARKET
    _, book, marks = ql.run_quotes(decided(s, d), KEYS, t)
    curve = running_peak(marks.withColumn("capital", F.lit(t.capital)), KEYS, "value")
    risk = curve.groupBy("asset").agg(F.max_by("value", "rn").alias("final_equity"), F.max(1 - F.col("value") / F.col("peak")).alias("max_drawdown"),
                                      (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("_us"))
    held = (F.unix_micros("exit_ts") - F.unix_micros("fill_ts")).cast("double")
    deals = book.filter("result = 'trade'").groupBy("asset").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.sum(held).alias("_held"),
                                                                F.sum(F.col("quantity") * (F.col("entry_price") + F.col("exit_price"))).alias("_traded"))
    return report(risk.join(deals, "asset").select("asset", "final_equity", F.greatest(F.lit(0.0), F.col("max_drawdown")).alias("max_drawdown"), "trades", "hit_rate",
                                                   (F.col("_held") / F.col("_us")).alias("exposure"), (F.col("_traded") / t.capital).alias("turnover")))


def quote_passive(s, d):
    """Buy at the first quote's signal and hold to the end."""
    q = quotes(s, d)
    first = q.groupBy("asset").agg(F.min(F.struct("ts", "sequence")).alias("_f")).select("asset", "_f.ts", "_f.sequence", F.lit(True).alias("_on"))
    marked = q.join(first, ["asset", "ts", "sequence"], "left").withColumn("entry", F.coalesce("_on", F.lit(False))).withColumn("exit", F.lit(False)).withColumn("decision", F.lit(True)).drop("_on")
    _, book, _ = ql.run_quotes(marked, KEYS, PASSIVE)
    return report(book.filter("result = 'trade'").select("asset", "entry_sequence", "exit_sequence", "entry_price", "exit_price", "pnl", "exit_reason"))


QUERIES = {
    "quote_order_fill": (
        lambda s, d: report(courses(s, d, LIMIT).select("asset", "submit", F.coalesce("cancel", F.lit(-1)).alias("cancel"), F.coalesce("fill", F.lit(-1)).alias("fill"), "outcome").withColumn(
            "fill", F.when(F.col("outcome") == "filled", F.col("fill")).otherwise(F.lit(-1)))),
        with_views("quotes", SIGNAL_4H, DECIDED, rows_sql(LIMIT), courses_sql(LIMIT), select="SELECT asset, rn AS submit, coalesce(cancel, -1) AS cancel, CASE WHEN outcome = 'filled' THEN fill ELSE -1 END AS fill, outcome FROM c1"),
    ),
    "first_touch_quotes": (
        lambda s, d: report(courses(s, d, MARKET).filter("outcome = 'filled'").select("asset", "submit", "fill", F.coalesce("trigger", F.lit(-1)).alias("trigger"), "reason", "exit_at", "exit_reason")),
        with_views("quotes", SIGNAL_4H, DECIDED, rows_sql(MARKET), courses_sql(MARKET), select="SELECT asset, rn AS submit, fill, coalesce(trig, -1) AS trigger, reason, xrow AS exit_at, xreason AS exit_reason FROM c WHERE outcome = 'filled'"),
    ),
    "quote_trades": (lambda s, d: trades(s, d, MARKET), sql(MARKET, TRADES)),
    "quote_limit_trades": (lambda s, d: trades(s, d, LIMIT), sql(LIMIT, TRADES)),
    "order_events": (
        lambda s, d: report(ql.order_events(ql.run_quotes(decided(s, d), KEYS, LIMIT)[1], KEYS)),
        sql(LIMIT, """SELECT asset, rn AS submit, 'entry_submit' AS event, rn AS position, NULL AS reason, round(lim, 6) AS price FROM book
          UNION ALL SELECT asset, rn, 'entry_cancel', cancel, CASE WHEN cancel = kx THEN 'expired' ELSE 'exit_signal' END, NULL FROM book WHERE result = 'cancelled'
          UNION ALL SELECT asset, rn, 'entry_cancel', last, 'segment_end', NULL FROM book WHERE result = 'pending'
          UNION ALL SELECT asset, rn, 'entry_rejected', fill, 'capital_or_minimum', NULL FROM book WHERE result = 'rejected'
          UNION ALL SELECT asset, rn, 'entry_fill', fill, NULL, round(ep, 6) FROM deal
          UNION ALL SELECT asset, rn, 'exit_trigger', trig, reason, NULL FROM deal WHERE trig IS NOT NULL AND reason <> 'target_limit'
          UNION ALL SELECT asset, rn, 'exit_fill', xrow, xreason, round(xp, 6) FROM deal"""),
    ),
    "quote_equity": (
        quote_equity,
        sql(MARKET, "SELECT g.asset, boundary, round(coalesce(value, 10000e0), 6) AS value FROM gr g ASOF LEFT JOIN marks m ON g.asset = m.asset AND g.boundary > m.ts", marks_sql(MARKET),
            "gr AS (SELECT asset, b AS boundary FROM fin, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS b))"),
    ),
    "quote_metrics": (
        quote_metrics,
        sql(MARKET, """SELECT r.asset, round(final_equity, 6) AS final_equity, round(dd, 6) AS max_drawdown, trades, round(hit, 6) AS hit_rate, round(held / us, 6) AS exposure, round(traded / 10000, 6) AS turnover FROM
          (SELECT asset, arg_max(value, rn) AS final_equity, greatest(0, max(1 - value / top)) AS dd, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM (
            SELECT *, greatest(10000e0, max(value) OVER (PARTITION BY asset ORDER BY rn)) AS top FROM marks) GROUP BY 1) r
          JOIN (SELECT asset, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS hit, sum(epoch_us(xts) - epoch_us(fts)) AS held, sum(qty * (ep + xp)) AS traded FROM deal GROUP BY 1) d USING (asset)""", marks_sql(MARKET)),
    ),
    "quote_passive": (
        quote_passive,
        with_views("quotes", "dec AS (SELECT asset, sequence, k = 1 AS entry, FALSE AS exit FROM (SELECT asset, sequence, row_number() OVER (PARTITION BY asset ORDER BY ts, sequence) AS k FROM quotes))",
                   rows_sql(PASSIVE), courses_sql(PASSIVE), walk_sql(PASSIVE),
                   select="SELECT asset, fs AS entry_sequence, xs AS exit_sequence, round(ep, 6) AS entry_price, round(xp, 6) AS exit_price, round(pnl, 6) AS pnl, xreason AS exit_reason FROM deal"),
    ),
}
