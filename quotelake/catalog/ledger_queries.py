"""Registered fills, exits, ledgers, equity and run metrics on bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import signals, ta
from ..operators import ledger as lg
from ..operators import metrics as mt
from ..plans import backtest
from ..plans.inputs import bars, quotes, report
from ..session import stage
from .common import with_views

KEYS = ["asset"]
# The costs and limits all registered bar runs share.
PARAMS = {"holding_cost_bps": 1.0, "quantity_step": 0.001, "max_holding": 20, "stop_loss": 0.1, "take_profit": 0.2,
          "fixed_commission": 1.0, "quote_side": 1, "spread_bps": 4.0}


def trend_bars(s, d):
    entry = signals.entry("trend", 5, 20)
    return ta.evaluate(backtest.positioned(bars(s, d), KEYS), {"entry": entry}, KEYS, ["ts"], position="rn")


def scenarios(b, names: dict[str, dict]):
    """One copy of the bars per scenario, with the scenario's parameters as columns."""
    dim = [F.struct(F.lit(n).alias("scenario"), *[F.lit(float(v)).alias(k) for k, v in sorted(ps.items())]) for n, ps in names.items()]
    fields = sorted({k for ps in names.values() for k in ps})
    return b.withColumn("_s", F.explode(F.array(*dim))).select(*b.columns, "_s.scenario", *[f"_s.{k}" for k in fields])


def trend_run(s, d, **kw):
    return backtest.run(trend_bars(s, d), KEYS, PARAMS, **kw)


# ---- oracle SQL: the same run walked candidate by candidate -------------------------------

TREND_SIGNAL = """sig AS (SELECT *, row_number() OVER w - 1 AS rn, coalesce(CASE WHEN count(*) OVER g = 20 THEN avg(close) OVER f > avg(close) OVER g END, FALSE) AS entry
  FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING))"""


def rows_sql(scen: str = "(VALUES ('base', 1e0, 1e0)) z(scenario, m, dir)", delay: int = 0, source: str = "sig",
             exit_expr: str = "NOT entry", segment: str = "TRUE", spread: float = 4.0, side: int = 1) -> str:
    """Rows of every scenario with fills and running carry, as in the ledger operators."""
    k = 1 + delay
    buy = f"CASE WHEN {side} = 1 THEN {spread} WHEN {side} = 2 THEN 0 ELSE {spread} / 2 END"
    sell = f"CASE WHEN {side} = 2 THEN {spread} WHEN {side} = 1 THEN 0 ELSE {spread} / 2 END"
    pay = lambda col, d: f"{col} * (1 + ({d}) * (CASE WHEN ({d}) > 0 THEN {buy} ELSE {sell} END + 5e0) / 1e4 * m)"
    return f"""lagged AS (SELECT asset, scenario, m, dir, ts, rn, open, high, low, close, coalesce(lag(entry, {k}) OVER w, FALSE) AS en, coalesce(lag({exit_expr}, {k}) OVER w, FALSE) AS ex,
    lag(close) OVER w AS seen, {pay('open', 'dir')} AS buy, {pay('open', '-dir')} AS sell, {pay('close', '-dir')} AS sell_close,
    coalesce(lag(close) OVER w * 1e0 / 1e4 * m * ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400e6), 0) AS cs
    FROM {source}, {scen} WINDOW w AS (PARTITION BY asset, scenario ORDER BY ts)),
  r AS MATERIALIZED (SELECT *, sum(cs) OVER (PARTITION BY asset, scenario ORDER BY rn) AS carry FROM lagged WHERE {segment}),
  fin AS (SELECT asset, scenario, max(rn) AS last FROM r GROUP BY 1, 2)"""


def exits_sql(stop: str = "0.1e0", take: str = "0.2e0", hold: str = "20") -> str:
    beyond = (f"CASE WHEN i.dir > 0 THEN j.seen <= i.buy * (1 - {stop}) OR j.seen >= i.buy * (1 + {take}) "
              f"ELSE j.seen >= i.buy * (1 + {stop}) OR j.seen <= i.buy * (1 - {take}) END")
    return f"""hits AS (SELECT i.asset, i.scenario, i.rn, min(j.rn) AS x FROM r i JOIN r j ON i.asset = j.asset AND i.scenario = j.scenario AND j.rn > i.rn AND j.rn <= i.rn + {hold}
    WHERE i.en AND NOT i.ex AND (j.ex OR j.rn = i.rn + {hold} OR {beyond}) GROUP BY 1, 2, 3),
  cand AS (SELECT i.asset, i.scenario, i.m, i.dir, i.rn, i.ts, i.buy AS ep, i.carry AS ec, coalesce(h.x, fin.last) AS xrow, h.x IS NULL AS atc
    FROM r i JOIN fin USING (asset, scenario) LEFT JOIN hits h USING (asset, scenario, rn) WHERE i.en AND NOT i.ex),
  c AS MATERIALIZED (SELECT cand.*, r.ts AS xts, CASE WHEN atc THEN r.sell_close ELSE r.sell END AS xp, r.carry - ec AS uc FROM cand JOIN r ON r.asset = cand.asset AND r.scenario = cand.scenario AND r.rn = xrow)"""


def walk_sql(fixed: str = "1e0", rate: str = "1e-3", step: str = "1e-3", alloc: str = "0.9e0", least: str = "5e0", capital: str = "1e4") -> str:
    return f"""hop AS MATERIALIZED (SELECT o.asset, o.scenario, o.at, min(c.rn) AS nx FROM (SELECT DISTINCT asset, scenario, xrow AS at FROM c UNION SELECT asset, scenario, rn FROM c UNION SELECT asset, scenario, -1 FROM fin) o
      LEFT JOIN c ON c.asset = o.asset AND c.scenario = o.scenario AND c.rn > o.at GROUP BY 1, 2, 3),
  walk AS (SELECT asset, scenario, CAST(-1 AS BIGINT) AS at, {capital} AS cash, 'start' AS kind, CAST(-1 AS BIGINT) AS rn, 0e0 AS qty, 0e0 AS pnl, 0e0 AS opened FROM fin
    UNION ALL SELECT asset, scenario, CASE WHEN q > 0 AND q * ep >= {least} THEN xrow ELSE rn END,
      CASE WHEN q > 0 AND q * ep >= {least} THEN cash - dir * q * ep - (q * ep * {rate} * m + {fixed} * m) - q * uc + dir * q * xp - (q * xp * {rate} * m + {fixed} * m) ELSE cash END,
      CASE WHEN q > 0 AND q * ep >= {least} THEN 'trade' ELSE 'skipped' END, rn, q,
      CASE WHEN q > 0 AND q * ep >= {least} THEN dir * q * (xp - ep) - (q * ep * {rate} * m + {fixed} * m) - q * uc - (q * xp * {rate} * m + {fixed} * m) ELSE 0 END,
      cash - dir * q * ep - (q * ep * {rate} * m + {fixed} * m)
    FROM (SELECT c.*, w.cash, floor(greatest(0, (w.cash * {alloc} - {fixed} * c.m) / (c.ep * (1 + {rate} * c.m))) / {step}) * {step} AS q
      FROM walk w JOIN hop h ON h.asset = w.asset AND h.scenario = w.scenario AND h.at = w.at JOIN c ON c.asset = h.asset AND c.scenario = h.scenario AND c.rn = h.nx WHERE w.cash > 0)),
  book AS (SELECT w.asset, w.scenario, w.kind, w.rn, c.xrow, c.ts AS ets, c.xts, c.dir, w.qty, c.ep, c.xp, w.pnl, c.atc, c.ec, w.opened, w.cash, c.m
    FROM walk w JOIN c USING (asset, scenario, rn) WHERE w.kind <> 'start'),
  deal AS (SELECT * FROM book WHERE kind = 'trade')"""


MARKS = """marks AS (SELECT r.asset, r.scenario, r.rn, r.ts, 1e4 AS capital,
    CASE WHEN d.rn IS NULL THEN 1e4 WHEN d.atc AND r.rn = d.xrow THEN d.cash WHEN r.rn < d.xrow THEN d.opened - d.qty * (r.carry - d.ec) + d.dir * d.qty * r.close ELSE d.cash END AS equity,
    CASE WHEN r.rn < d.xrow OR (d.atc AND r.rn = d.xrow) THEN d.opened - d.qty * (r.carry - d.ec) + d.dir * d.qty * CASE WHEN d.dir > 0 THEN r.low ELSE r.high END END AS worst
    FROM r ASOF LEFT JOIN deal d ON r.asset = d.asset AND r.scenario = d.scenario AND r.rn >= d.rn),
  perf AS (SELECT *, equity / coalesce(lag(equity) OVER w, capital) - 1 AS ret, greatest(capital, max(equity) OVER w) AS peak,
    greatest(capital, max(equity) OVER (PARTITION BY asset, scenario ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prior_peak
    FROM marks WINDOW w AS (PARTITION BY asset, scenario ORDER BY rn))"""

METRICS = """risk AS (SELECT asset, scenario, count(*) AS bars, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0 END AS sharpe,
    arg_max(equity, rn) AS final_equity, greatest(0, max(1 - equity / peak)) AS max_drawdown, greatest(0, coalesce(max(1 - worst / prior_peak), 0)) AS intrabar_drawdown,
    avg(CASE WHEN worst IS NOT NULL THEN 1e0 ELSE 0e0 END) AS exposure, min(equity) AS least FROM perf GROUP BY 1, 2),
  deals AS (SELECT asset, scenario, count(*) FILTER (kind = 'trade') AS trades, count(*) FILTER (kind = 'skipped') AS skipped_orders, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gains,
    coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS losses, coalesce(avg(pnl) FILTER (kind = 'trade'), 0) AS expectancy, coalesce(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) FILTER (kind = 'trade'), 0) AS hit_rate,
    coalesce(sum(qty * (ep + xp)) FILTER (kind = 'trade'), 0) AS traded FROM book GROUP BY 1, 2),
  metrics AS (SELECT risk.*, coalesce(trades, 0) AS trades, coalesce(skipped_orders, 0) AS skipped_orders, coalesce(expectancy, 0) AS expectancy, coalesce(hit_rate, 0) AS hit_rate, final_equity / 1e4 - 1 AS net_return,
    CASE WHEN losses > 0 THEN gains / losses WHEN gains > 0 THEN NULL ELSE 0 END AS profit_factor, coalesce(gains > 0 AND losses = 0, FALSE) AS no_losing_trades,
    least <= 0 OR intrabar_drawdown >= 1 AS bankrupt, coalesce(traded, 0) / 1e4 AS turnover FROM risk LEFT JOIN deals USING (asset, scenario))"""

METRIC_COLS = ("sharpe", "final_equity", "max_drawdown", "intrabar_drawdown", "exposure", "expectancy", "hit_rate", "net_return", "profit_factor", "turnover")
METRIC_SELECT = "asset, bars, trades, skipped_orders, no_losing_trades, bankrupt, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRIC_COLS)
METRIC_OUT = ["bars", "trades", "skipped_orders", "no_losing_trades", "bankrupt", *METRIC_COLS]


def run_sql(select: str, scen: str | None = None, marks: bool = False, metrics: bool = False, **kw) -> str:
    exits = {k: kw.pop(k) for k in ("stop", "take", "hold") if k in kw}
    rows = rows_sql(scen, **kw) if scen else rows_sql(**kw)
    ctes = [TREND_SIGNAL, rows, exits_sql(**exits), walk_sql()]
    if marks or metrics:
        ctes.append(MARKS)
    if metrics:
        ctes.append(METRICS)
    return with_views("bars", *ctes, select=select)


TRADES_SELECT = """asset, rn AS entry_row, xrow AS exit_row, ets AS entry_ts, xts AS exit_ts, round(qty, 6) AS quantity, round(ep, 6) AS entry_price,
  round(xp, 6) AS exit_price, round(pnl, 6) AS pnl, atc AS exit_at_close, xrow - rn AS holding_bars"""


def trades_out(book, *extra):
    return report(book.filter("kind = 'trade'").select(
        "asset", *extra, "entry_row", "exit_row", "entry_ts", "exit_ts", "quantity", "entry_price", "exit_price", "pnl", "exit_at_close",
        (F.col("exit_row") - F.col("entry_row")).alias("holding_bars")))


def execution_price(s, d):
    """Open and close fills of both sides, on assumed and on observed spreads."""
    b = bars(s, d)
    observed = b.withColumns({"bid_open": F.col("open") - 0.02, "ask_open": F.col("open") + 0.02,
                              "bid_close": F.col("close") - 0.03, "ask_close": F.col("close") + 0.03})
    side = lambda x: F.lit(x)
    parts = []
    for q in (0, 1, 2):
        p = {**PARAMS, "quote_side": q, "cost_multiplier": 2.0}
        parts.append(b.select("asset", "ts", F.lit(f"side{q}").alias("model"), lg.execution_price(b, p, side(1)).alias("buy"),
                              lg.execution_price(b, p, side(-1), "close").alias("sell")))
    parts.append(observed.select("asset", "ts", F.lit("observed").alias("model"), lg.execution_price(observed, {"cost_multiplier": 2.0}, side(1)).alias("buy"),
                                 lg.execution_price(observed, {"cost_multiplier": 2.0}, side(-1), "close").alias("sell")))
    return report(reduce(lambda a, c: a.unionByName(c), parts), 9)


def next_open_fill(s, d):
    rows = lg.execution_rows(trend_bars(s, d), KEYS, PARAMS, delay=1)
    return report(lg.candidates(rows).select("asset", "rn", "ts", F.col("buy").alias("price")))


def bar_exit_scan(s, d):
    rows = stage(lg.execution_rows(trend_bars(s, d), KEYS, PARAMS))
    return report(lg.exit_scan(rows, KEYS, PARAMS, 20).select("asset", "rn", "exit_row", "exit_at_close"))


def trade_chain(s, d):
    """Which candidates start a position: the next one begins after the last exit."""
    return report(trend_run(s, d).ledger.select("asset", "kind", "entry_row", "exit_row"))


def equity_curve(s, d):
    r = trend_run(s, d)
    return report(r.returns().select("asset", "ts", "equity", "ret"), 8)


def drawdown(s, d):
    r = trend_run(s, d)
    curve = mt.running_peak(r.marks, KEYS)
    return report(curve.select("asset", "ts", (1 - F.col("equity") / F.col("peak")).alias("drawdown"),
                               F.when(F.col("worst").isNotNull(), 1 - F.col("worst") / F.col("prior_peak")).alias("intrabar")), 8)


def cost_stress(s, d):
    b = scenarios(trend_bars(s, d), {f"x{m}": {"cost_multiplier": m} for m in (1, 2, 3)})
    return report(backtest.run(b, ["asset", "scenario"], PARAMS).metrics().select("asset", "scenario", *METRIC_OUT))


def short_ledger(s, d):
    b = scenarios(trend_bars(s, d), {"long": {"direction": 1}, "short": {"direction": -1}})
    return trades_out(backtest.run(b, ["asset", "scenario"], PARAMS).ledger, "scenario")


def signal_delay(s, d):
    return report(trend_run(s, d, delay=1).metrics().select("asset", *METRIC_OUT))


PASSIVE = {**PARAMS, "stop_loss": 1.0, "take_profit": 1e100, "max_holding": 1_000_000_000}


def passive_run(s, d, **kw):
    return backtest.run(lg.buy_and_hold(backtest.positioned(bars(s, d), KEYS)), KEYS, PASSIVE, **kw)


def buy_and_hold(s, d):
    return report(passive_run(s, d).metrics().select("asset", *METRIC_OUT))


def compound_return(s, d):
    r = trend_run(s, d).returns()
    return report(r.groupBy("asset", F.year("ts").alias("year")).agg(mt.compound(F.col("ret")).alias("compounded"), F.count(F.lit(1)).alias("bars")))


def baseline_delta(s, d):
    """A filtered trend rule against the same rule without filters."""
    plain = signals.entry("trend", 5, 20)
    strict = signals.entry("trend", 5, 20, regime_name="uptrend", confirmation="strong_close")
    b = ta.evaluate(backtest.positioned(bars(s, d), KEYS), {"plain": plain, "strict": strict}, KEYS, ["ts"], position="rn")
    both = b.withColumn("_s", F.explode(F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("plain").alias("entry")),
        F.struct(F.lit("filtered").alias("scenario"), F.col("strict").alias("entry"))))).select(
            *[c for c in b.columns if c not in ("plain", "strict")], "_s.*")
    m = backtest.run(both, ["asset", "scenario"], PARAMS).metrics()
    return report(mt.baseline_delta(m, ["asset"], "scenario", "baseline"))


BASELINE_SIGNAL = """sig0 AS (SELECT *, row_number() OVER w - 1 AS rn, coalesce(CASE WHEN count(*) OVER g = 20 THEN avg(close) OVER f > avg(close) OVER g END, FALSE) AS plain,
    coalesce(CASE WHEN count(*) OVER g = 20 THEN close > avg(close) OVER g END, FALSE) AND coalesce((close - low) / nullif(high - low, 0) >= 0.75e0, FALSE) AS strict
  FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  sig AS (SELECT sig0.*, CASE WHEN scenario = 'baseline' THEN plain ELSE plain AND strict END AS entry, scenario FROM sig0, (VALUES ('baseline'), ('filtered')) z(scenario))"""


QUERIES = {
    "execution_price": (
        execution_price,
        with_views("bars", select="\nUNION ALL ".join(
            [f"SELECT asset, ts, 'side{q}' AS model, round(open * (1 + ({b} + 5e0) / 1e4 * 2), 9) AS buy, round(close * (1 - ({a} + 5e0) / 1e4 * 2), 9) AS sell FROM bars"
             for q, b, a in ((0, 2, 2), (1, 4, 0), (2, 0, 4))]
            + ["SELECT asset, ts, 'observed', round(open + (2e-2 * 2 + open * 5e0 / 1e4 * 2), 9), round(close - (3e-2 * 2 + close * 5e0 / 1e4 * 2), 9) FROM bars"])),
    ),
    "next_open_fill": (
        next_open_fill,
        with_views("bars", TREND_SIGNAL, rows_sql(delay=1), select="SELECT asset, rn, ts, round(buy, 6) AS price FROM r WHERE en AND NOT ex"),
    ),
    "bar_exit_scan": (
        bar_exit_scan,
        with_views("bars", TREND_SIGNAL, rows_sql(), exits_sql(), select="SELECT asset, rn, xrow AS exit_row, atc AS exit_at_close FROM c"),
    ),
    "trade_chain": (trade_chain, run_sql("SELECT asset, kind, rn AS entry_row, CASE WHEN kind = 'trade' THEN xrow ELSE rn END AS exit_row FROM book")),
    "trade_ledger": (lambda s, d: trades_out(trend_run(s, d).ledger), run_sql(f"SELECT {TRADES_SELECT} FROM deal")),
    "short_ledger": (
        short_ledger,
        run_sql(f"SELECT scenario, {TRADES_SELECT} FROM deal", "(VALUES ('long', 1e0, 1e0), ('short', 1e0, -1e0)) z(scenario, m, dir)"),
    ),
    "equity_curve": (equity_curve, run_sql("SELECT asset, ts, round(equity, 8) AS equity, round(ret, 8) AS ret FROM perf", marks=True)),
    "drawdown": (
        drawdown,
        run_sql("SELECT asset, ts, round(1 - equity / peak, 8) AS drawdown, round(1 - worst / prior_peak, 8) AS intrabar FROM perf", marks=True),
    ),
    "run_metrics": (
        lambda s, d: report(trend_run(s, d).metrics().select("asset", *METRIC_OUT)),
        run_sql(f"SELECT {METRIC_SELECT} FROM metrics", metrics=True),
    ),
    "cost_stress": (
        cost_stress,
        run_sql(f"SELECT scenario, {METRIC_SELECT} FROM metrics", "(VALUES ('x1', 1e0, 1e0), ('x2', 2e0, 1e0), ('x3', 3e0, 1e0)) z(scenario, m, dir)", metrics=True),
    ),
    "signal_delay": (signal_delay, run_sql(f"SELECT {METRIC_SELECT} FROM metrics", delay=1, metrics=True)),
    "buy_and_hold": (
        buy_and_hold,
        with_views("bars", "sig AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS rn, TRUE AS entry FROM bars)",
                   rows_sql(exit_expr="FALSE"),
                   """c AS MATERIALIZED (SELECT i.asset, i.scenario, i.m, i.dir, i.rn, i.ts, i.buy AS ep, i.carry AS ec, f.last AS xrow, TRUE AS atc, x.ts AS xts, x.sell_close AS xp, x.carry - i.carry AS uc
                     FROM r i JOIN fin f USING (asset, scenario) JOIN r x ON x.asset = i.asset AND x.scenario = i.scenario AND x.rn = f.last WHERE i.rn = 1)""",
                   walk_sql(), MARKS, METRICS, select=f"SELECT {METRIC_SELECT} FROM metrics"),
    ),
    "compound_return": (
        compound_return,
        run_sql("SELECT asset, year(ts) AS year, round(exp(sum(ln(1 + ret))) - 1, 6) AS compounded, count(*) AS bars FROM perf GROUP BY 1, 2", marks=True),
    ),
    "baseline_delta": (
        baseline_delta,
        with_views("bars", BASELINE_SIGNAL, rows_sql("(VALUES (1e0, 1e0)) z(m, dir)"),
                   exits_sql(), walk_sql(), MARKS, METRICS,
                   select="""SELECT a.asset, a.scenario, round(a.net_return - b.net_return, 6) AS net_return_difference, round(a.sharpe - b.sharpe, 6) AS sharpe_difference
                     FROM metrics a JOIN metrics b ON a.asset = b.asset AND b.scenario = 'baseline' WHERE a.scenario <> 'baseline'"""),
    ),
}
