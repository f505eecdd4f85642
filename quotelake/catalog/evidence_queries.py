"""Registered statistical evidence, robustness and diagnostics."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import normal, signals, ta
from ..functions.guards import add_seconds, floor_ts
from ..functions.sampling import draw_sql
from ..operators import evidence as ev
from ..operators import folds as tf
from ..operators import ledger as lg
from ..operators import metrics
from ..operators.metrics import compound
from ..plans import backtest
from ..plans.inputs import bars, quotes, report, table
from ..session import stage
from .common import with_views
from .ledger_queries import (KEYS, MARKS, METRIC_SELECT, METRICS, PARAMS, PASSIVE, TREND_SIGNAL, exits_sql, rows_sql, run_sql, scenarios,
                             trend_bars, walk_sql)
from .time_queries import HOURLY, hourly

SPLIT = 0.6
FOLDS = 3


def strategy_series(s, d):
    """Returns of holding each asset while its trend signal was on, beside the asset's own."""
    rows = trend_bars(s, d)
    from ..operators.blocks import with_previous

    r = with_previous(rows, KEYS, ["ts"], {"_c": "close", "_on": "entry"}).filter("rn > 0")
    market = F.col("close") / F.col("_c") - 1
    return stage(r.select("asset", "ts", (F.col("rn") - 1).alias("rn"), market.alias("market"), F.when(F.col("_on"), market).otherwise(0.0).alias("ret")))


STRAT = """strat AS MATERIALIZED (SELECT asset, ts, rn - 1 AS rn, market, CASE WHEN held THEN market ELSE 0e0 END AS ret FROM (
    SELECT *, close / lag(close) OVER w - 1 AS market, lag(entry) OVER w AS held FROM sig WINDOW w AS (PARTITION BY asset ORDER BY ts)) WHERE rn > 0),
  size AS MATERIALIZED (SELECT asset, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM strat GROUP BY 1)"""

HAC = """m AS (SELECT asset, count(*) AS n, regr_slope(ret, market) AS beta, regr_intercept(ret, market) AS alpha, sum(market) AS sx, sum(market * market) AS sxx, avg(ret) AS my,
    least(count(*) - 1, greatest(1, CAST(floor(4 * pow(count(*) / 100, 2e0 / 9)) AS BIGINT))) AS lags FROM strat GROUP BY 1),
  e AS MATERIALIZED (SELECT asset, rn, ret - alpha - beta * market AS e, (ret - alpha - beta * market) * market AS ex, lags, (ret - my) * (ret - my) AS dev FROM strat JOIN m USING (asset)),
  meat AS (SELECT asset, sum(e * e) AS s11, sum(e * ex) AS s12, sum(ex * ex) AS s22, sum(dev) AS sst FROM e GROUP BY 1),
  crossed AS (SELECT a.asset, sum((1 - (a.rn - b.rn) / (a.lags + 1)) * 2 * a.e * b.e) AS c11, sum((1 - (a.rn - b.rn) / (a.lags + 1)) * (a.e * b.ex + a.ex * b.e)) AS c12,
    sum((1 - (a.rn - b.rn) / (a.lags + 1)) * 2 * a.ex * b.ex) AS c22 FROM e a JOIN e b ON a.asset = b.asset AND b.rn < a.rn AND b.rn >= a.rn - a.lags GROUP BY 1),
  v AS (SELECT *, sxx / (n * sxx - sx * sx) AS p, -sx / (n * sxx - sx * sx) AS q FROM m JOIN meat USING (asset) JOIN crossed USING (asset)),
  u AS (SELECT *, sqrt((p * p * (s11 + c11) + 2 * p * q * (s12 + c12) + q * q * (s22 + c22)) * n / (n - 2)) AS se FROM v)"""


def sampled(source: str, size: str, samples: int, block: str, seed: int = 42) -> str:
    """Resampled series of every path: asset, block, path, pos, ret."""
    return f"""blocksize AS (SELECT asset, n, {block} AS block FROM {size}),
  draws AS (SELECT *, {draw_sql(seed, 'path', 'k', 'block')} % n AS start FROM (SELECT asset, n, block, path, unnest(range(CAST(ceil(n / block) AS BIGINT))) AS k FROM blocksize, range({samples}) p(path))),
  sample AS (SELECT d.asset, d.block, d.path, d.n, d.k * d.block + o AS pos, s.ret FROM (SELECT *, unnest(range(CAST(block AS BIGINT))) AS o FROM draws) d
    JOIN {source} s ON s.asset = d.asset AND s.rn = (d.start + d.o) % d.n WHERE d.k * d.block + o < d.n)"""


PATHS = """curves AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset, block, path ORDER BY pos)) AS c FROM sample),
  peaks AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY asset, block, path ORDER BY pos)) AS top FROM curves),
  paths AS (SELECT asset, block, path, arg_max(c, pos) - 1 AS profit, greatest(0, max(1 - c / top)) AS dd, least(1, min(c)) AS low FROM peaks GROUP BY 1, 2, 3)"""


def luck(trials: int) -> float:
    unit, g = NormalDist(), 0.5772156649015329
    return -(1 - g) * unit.inv_cdf(1 / trials) - g * unit.inv_cdf(1 / (trials * math.e))


Z_MIN = -NormalDist().inv_cdf(0.05 / 2)
CUBE_ROOT = "CAST(greatest(2, round_even(pow(CAST(n AS DOUBLE), 1e0 / 3), 0)) AS BIGINT)"


def dsr_sql(source: str, size: str, trials: int, samples: int = 200) -> tuple[str, ...]:
    return (
        sampled(source, size, samples, CUBE_ROOT),
        f"""spread AS (SELECT asset, stddev_samp(sr) AS disp FROM (SELECT s.asset, path, avg(s.ret - z.mean) / greatest(stddev_samp(s.ret - z.mean), 1e-12) AS sr
      FROM sample s JOIN {size} z USING (asset) GROUP BY 1, 2) GROUP BY 1),
  shape AS (SELECT asset, avg(pow((ret - mean) / sd, 3)) AS skew, avg(pow((ret - mean) / sd, 4)) AS kurt FROM {source} JOIN {size} USING (asset) GROUP BY 1),
  dz AS (SELECT asset, disp * {luck(trials)!r}::DOUBLE AS bench, least(CAST(n AS DOUBLE), 1 + 1 / greatest(disp * disp, 1e-12)) AS eff,
    (mean / sd - disp * {luck(trials)!r}::DOUBLE) * sqrt(least(CAST(n AS DOUBLE), 1 + 1 / greatest(disp * disp, 1e-12)) - 1)
      / sqrt(greatest(1e-12, 1 - skew * mean / sd + (kurt - 1) / 4 * (mean / sd) * (mean / sd))) AS z FROM {size} JOIN spread USING (asset) JOIN shape USING (asset))""",
    )


def names(*scen: str) -> str:
    return "(VALUES " + ", ".join(f"('{x}', 1e0, 1e0)" for x in scen) + ") z(scenario, m, dir)"


def segment_cte(ranges: dict[str, tuple[str, str]]) -> str:
    return "seg AS MATERIALIZED (SELECT * FROM (SELECT asset, count(*) AS n FROM bars GROUP BY 1), (VALUES " + ", ".join(f"('{k}')" for k in ranges) + ") z(scenario)), bounds AS MATERIALIZED (SELECT asset, scenario, CASE scenario " + \
        " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in ranges.items()) + " END AS a, CASE scenario " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in ranges.items()) + " END AS b FROM seg)"


IN_SEGMENT = "EXISTS (SELECT 1 FROM bounds WHERE bounds.asset = lagged.asset AND bounds.scenario = lagged.scenario AND rn >= a AND rn < b)"
SPLIT_SQL = "CAST(floor(n * 0.6e0) AS BIGINT)"


def edge(i: int) -> str:
    return f"CAST(floor({SPLIT_SQL} + (n - {SPLIT_SQL}) * {i} / {FOLDS}) AS BIGINT)"


IS_OOS = {"is": ("20", SPLIT_SQL), "oos": (SPLIT_SQL, "n")}
WINDOWS = {f"w{i}": (edge(i - 1), edge(i)) for i in range(1, FOLDS + 1)}
TRAINS = {f"t{i}": ("20", f"{edge(i - 1)} - 20") for i in range(1, FOLDS + 1)}


def segmented_sql(select: str, ranges: dict, *more: str, passive: bool = False, tail: str = METRICS) -> str:
    """A run per segment; with ``passive`` the scenario of that name holds throughout."""
    ctes = [TREND_SIGNAL, segment_cte(ranges)]
    if passive:
        ctes[0] = TREND_SIGNAL.replace("sig AS", "sig0 AS") + ", sig AS (SELECT sig0.* EXCLUDE (entry), scenario, scenario = 'passive' OR entry AS entry FROM sig0, (VALUES " + ", ".join(f"('{k}')" for k in ranges) + ") z(scenario))"
        ctes.append(rows_sql("(VALUES (1e0, 1e0)) z(m, dir)", exit_expr="scenario <> 'passive' AND NOT entry", segment=IN_SEGMENT))
        case = lambda p, q: f"CASE WHEN i.scenario = 'passive' THEN {p} ELSE {q} END"
        ctes.append(exits_sql(case("1e0", "0.1e0"), case("1e100", "0.2e0"), case("100000000", "20")))
    else:
        ctes += [rows_sql(names(*ranges), segment=IN_SEGMENT), exits_sql()]
    return with_views("bars", *ctes, walk_sql(), MARKS, tail, *more, select=select)


def sizes(rows):
    return rows.groupBy("asset").agg((F.max("rn") + 1).alias("n"))


def ranges_df(rows, with_windows=False):
    n = sizes(rows)
    split = F.floor(F.col("n") * SPLIT)
    edge_col = lambda i: F.floor(split + (F.col("n") - split) * i / FOLDS)
    parts = [F.struct(F.lit("is").alias("segment"), F.lit(20).cast("long").alias("seg_from"), split.alias("seg_to")),
             F.struct(F.lit("oos").alias("segment"), split.alias("seg_from"), F.col("n").cast("long").alias("seg_to"))]
    if with_windows:
        parts += [F.struct(F.lit(f"w{i}").alias("segment"), edge_col(i - 1).alias("seg_from"), edge_col(i).alias("seg_to")) for i in range(1, FOLDS + 1)]
    return n.select("asset", F.explode(F.array(*parts)).alias("s")).select("asset", "s.*")


def passive_oos(rows):
    n = sizes(rows)
    seg = n.select("asset", F.lit("passive").alias("segment"), F.floor(F.col("n") * SPLIT).alias("seg_from"), F.col("n").alias("seg_to"))
    return backtest.run(lg.buy_and_hold(rows.drop("entry")), KEYS, PASSIVE, segments=seg).metrics().drop("segment")


def walk_forward(s, d):
    rows = stage(trend_bars(s, d))
    f = ev.fold_bounds(sizes(rows), F.floor(F.col("n") * SPLIT), FOLDS, PARAMS["max_holding"])
    parts = F.array(
        F.struct(F.concat(F.lit("train"), F.col("fold").cast("string")).alias("segment"), F.lit(20).cast("long").alias("seg_from"), F.col("train_to").alias("seg_to")),
        F.struct(F.concat(F.lit("test"), F.col("fold").cast("string")).alias("segment"), F.col("test_from").alias("seg_from"), F.col("test_to").alias("seg_to")))
    seg = f.select("asset", F.explode(parts).alias("p")).select("asset", "p.*")
    run = backtest.run(rows, KEYS, PARAMS, segments=seg)
    m = run.metrics().withColumn("part", F.regexp_extract("segment", "[a-z]+", 0)).withColumn("fold", F.regexp_extract("segment", "[0-9]+", 0).cast("int"))
    tests = run.returns().filter(F.col("segment").startswith("test")).select("asset", "rn", "ret")
    return report(ev.walk_forward(m, tests, KEYS, FOLDS))


VIABLE = "(NOT bankrupt AND net_return > 0 AND sharpe > 0 AND greatest(max_drawdown, intrabar_drawdown) <= {dd}e0 AND trades >= {n})"
WALK_TAIL = f"""fold AS (SELECT t.asset, substr(t.scenario, 2) AS fold, {VIABLE.format(dd=0.25, n=10).replace('NOT bankrupt', 'NOT t.bankrupt').replace('net_return', 't.net_return').replace('sharpe', 't.sharpe').replace('max_drawdown', 't.max_drawdown').replace('intrabar_drawdown', 't.intrabar_drawdown').replace('trades', 't.trades')}
      AND {VIABLE.format(dd=0.25, n=30).replace('NOT bankrupt', 'NOT g.bankrupt').replace('net_return', 'g.net_return').replace('sharpe', 'g.sharpe').replace('max_drawdown', 'g.max_drawdown').replace('intrabar_drawdown', 'g.intrabar_drawdown').replace('trades', 'g.trades')} AS ok, t.trades,
      t.bankrupt OR greatest(t.max_drawdown, t.intrabar_drawdown) > 0.25e0 AS broken FROM metrics t JOIN metrics g ON g.asset = t.asset AND g.scenario = 't' || substr(t.scenario, 2) WHERE t.scenario LIKE 'w%'),
  jc AS (SELECT asset, rn, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY rn)) AS e FROM perf WHERE scenario LIKE 'w%'),
  jp AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY asset ORDER BY rn)) AS top FROM jc),
  jd AS (SELECT asset, arg_max(e, rn) - 1 AS net_return, greatest(0, max(1 - e / top)) AS max_drawdown FROM jp GROUP BY 1),
  ft AS (SELECT asset, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS passing_folds, CAST(sum(trades) AS BIGINT) AS trades, bool_or(broken) AS broken FROM fold GROUP BY 1)"""


def benchmark_compare(s, d):
    rows = stage(trend_bars(s, d))
    m = backtest.run(rows, KEYS, PARAMS, segments=ranges_df(rows)).metrics().filter("segment = 'oos'")
    return report(ev.benchmark_compare(m, passive_oos(rows), KEYS))


def forward_windows(s, d):
    rows = stage(trend_bars(s, d))
    m = backtest.run(rows, KEYS, PARAMS, segments=ranges_df(rows, True)).metrics().filter(F.col("segment").startswith("w"))
    return report(m.groupBy("asset").agg(F.sum((F.col("net_return") > 0).cast("int")).alias("positive_windows"), F.min("net_return").alias("worst"), F.max("net_return").alias("best")))


def _wide(m, tags):
    cols = ["net_return", "sharpe", "max_drawdown", "intrabar_drawdown", "trades", "profit_factor", "no_losing_trades"]
    pick = lambda t, c: F.max(F.when(F.col("segment") == t, F.col(c))).alias(f"{t}_{c}")
    return m.groupBy("asset").agg(*[pick(t, c) for t in tags for c in cols],
                                  F.sum((F.col("segment").startswith("w") & (F.col("net_return") > 0)).cast("int")).alias("positive_windows"))


def oos_degradation(s, d):
    rows = stage(trend_bars(s, d))
    w = _wide(backtest.run(rows, KEYS, PARAMS, segments=ranges_df(rows)).metrics(), ["is", "oos"])
    return report(w.select("asset", "is_sharpe", "oos_sharpe", ev.degradation(F.col("is_sharpe"), F.col("oos_sharpe")).alias("degradation")))


def _gates(rows):
    run = backtest.run(rows, KEYS, PARAMS, segments=ranges_df(rows, True))
    w = _wide(run.metrics(), ["is", "oos"])
    bench = ev.benchmark_compare(run.metrics().filter("segment = 'oos'").drop("segment"), passive_oos(rows), KEYS).select("asset", F.col("passed").alias("benchmark_passed"))
    first = run.rows.filter("segment = 'oos'").groupBy("asset").agg(F.min("rn").alias("_f"))
    oos = stage(run.returns().filter("segment = 'oos'").join(first, "asset").select("asset", "ts", (F.col("rn") - F.col("_f")).alias("rn"), "ret"))
    dsr = ev.deflated_sharpe(oos, KEYS, 100).select("asset", "dsr", "dsr_z", "sequential_passed")
    return run, oos, w.join(bench, "asset").join(dsr, "asset").withColumn("execution_delay_bars", F.lit(0))


def gate_report(s, d):
    _, _, wide = _gates(stage(trend_bars(s, d)))
    out = wide.withColumn("reasons", ev.gate_reasons())
    return report(out.select("asset", "dsr_z", "positive_windows", "benchmark_passed", F.concat_ws(",", "reasons").alias("reasons"), (F.size("reasons") == 0).alias("passed")))


def gate_checklist(s, d):
    """The gates in long form: label, value, passed."""
    _, _, w = _gates(stage(trend_bars(s, d)))
    item = lambda n, v, ok: F.struct(F.lit(n).alias("label"), v.cast("double").alias("value"), ok.alias("passed"))
    c = F.col
    items = [item("dsr", c("dsr"), c("dsr") >= 0.95), item("dsr_z", c("dsr_z"), c("dsr_z") > 1.2),
             item("windows", c("positive_windows"), c("positive_windows") >= 2)]
    for p in ("is", "oos"):
        items += [item(f"{p}_sharpe", c(f"{p}_sharpe"), c(f"{p}_sharpe") > 0), item(f"{p}_trades", c(f"{p}_trades"), c(f"{p}_trades") >= 30),
                  item(f"{p}_drawdown", c(f"{p}_max_drawdown"), c(f"{p}_max_drawdown") <= 0.25), item(f"{p}_return", c(f"{p}_net_return"), c(f"{p}_net_return") > 0)]
    return report(w.select("asset", F.explode(F.array(*items)).alias("i")).select("asset", "i.*"))


GATE_RANGES = {**IS_OOS, **WINDOWS, "passive": (SPLIT_SQL, "n")}
GATE_TAIL = (
    f"""oser AS MATERIALIZED (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY rn) - 1 AS rn, ret FROM perf WHERE scenario = 'oos'),
  osize AS MATERIALIZED (SELECT asset, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM oser GROUP BY 1)""",
    *dsr_sql("oser", "osize", 100),
    f"""gates AS (SELECT o.asset, z AS dsr_z, {normal.cdf_sql('z')} AS dsr, i.sharpe AS is_sharpe, o.sharpe AS oos_sharpe, i.trades AS is_trades, o.trades AS oos_trades,
      i.max_drawdown AS is_dd, o.max_drawdown AS oos_dd, i.intrabar_drawdown AS is_id, o.intrabar_drawdown AS oos_id, i.net_return AS is_ret, o.net_return AS oos_ret, o.no_losing_trades AS nl, o.profit_factor AS pf,
      (SELECT count(*) FROM metrics x WHERE x.asset = o.asset AND x.scenario LIKE 'w%' AND x.net_return > 0) AS positive_windows,
      o.net_return > 0 AND o.trades > 0 AND o.sharpe > p.sharpe AND (o.net_return > p.net_return OR o.max_drawdown < p.max_drawdown) AS benchmark_passed
    FROM metrics o JOIN metrics i ON i.asset = o.asset AND i.scenario = 'is' JOIN metrics p ON p.asset = o.asset AND p.scenario = 'passive' JOIN dz ON dz.asset = o.asset WHERE o.scenario = 'oos')""",
)
GATE_SELECT = f"""SELECT *, reasons = '' AS passed FROM (SELECT asset, round(dsr_z, 6) AS dsr_z, positive_windows, benchmark_passed, concat_ws(',',
    CASE WHEN dsr < 0.95e0 OR dsr_z <= 1.2e0 THEN 'deflated_sharpe' END, CASE WHEN dsr_z < {Z_MIN!r}::DOUBLE THEN 'sequential_evidence' END,
    CASE WHEN is_sharpe <= 0 OR oos_sharpe <= 0 OR greatest(0, 1 - oos_sharpe / is_sharpe) > 0.2e0 THEN 'sharpe_or_degradation' END,
    CASE WHEN is_trades < 30 OR oos_trades < 30 THEN 'too_few_trades' END,
    CASE WHEN greatest(is_dd, is_id) > 0.25e0 OR is_ret <= 0 OR greatest(oos_dd, oos_id) > 0.25e0 OR oos_ret <= 0 THEN 'return_or_drawdown' END,
    CASE WHEN NOT (nl OR coalesce(pf, 0) >= 1.2e0) THEN 'profit_factor' END, CASE WHEN positive_windows < 2 THEN 'forward_windows' END,
    CASE WHEN NOT benchmark_passed THEN 'benchmark' END) AS reasons FROM gates)"""


# ---- parameter robustness: one-at-a-time and joint variants of one rule -------------------

# (fast, slow, stop_loss, take_profit, allocation, max_holding) of each variant.
VARIANTS = {
    "fast-": (4, 20, 0.1, 0.2, 0.9, 20), "fast+": (6, 20, 0.1, 0.2, 0.9, 20), "slow-": (5, 16, 0.1, 0.2, 0.9, 20), "slow+": (5, 24, 0.1, 0.2, 0.9, 20),
    "stop-": (5, 20, 0.08, 0.2, 0.9, 20), "stop+": (5, 20, 0.12, 0.2, 0.9, 20), "take-": (5, 20, 0.1, 0.16, 0.9, 20), "take+": (5, 20, 0.1, 0.24, 0.9, 20),
    "alloc-": (5, 20, 0.1, 0.2, 0.72, 20), "alloc+": (5, 20, 0.1, 0.2, 0.95, 20), "hold-": (5, 20, 0.1, 0.2, 0.9, 16), "hold+": (5, 20, 0.1, 0.2, 0.9, 24),
    "joint1": (4, 24, 0.12, 0.2, 0.9, 20), "joint2": (6, 16, 0.1, 0.24, 0.72, 20), "joint3": (5, 20, 0.08, 0.16, 0.9, 16), "joint4": (4, 20, 0.12, 0.24, 0.9, 24),
}


def variant_rows(s, d, variants):
    pairs = sorted({(f, w) for f, w, *_ in variants.values()})
    rows = ta.evaluate(backtest.positioned(bars(s, d), KEYS), {f"e_{f}_{w}": signals.entry("trend", f, w) for f, w in pairs}, KEYS, ["ts"], position="rn")
    dims = F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"e_{f}_{w}").alias("entry"), F.lit(sl).alias("stop_loss"), F.lit(tp).alias("take_profit"),
                              F.lit(al).alias("allocation"), F.lit(h).alias("max_holding")) for n, (f, w, sl, tp, al, h) in variants.items()])
    keep = [c for c in rows.columns if not c.startswith("e_")]
    return rows.withColumn("_v", F.explode(dims)).select(*keep, "_v.*")


def param_stress(s, d):
    run = backtest.run(variant_rows(s, d, VARIANTS), ["asset", "scenario"], {**PARAMS, "max_holding": 24})
    m = run.metrics().withColumn("joint", F.col("scenario").startswith("joint")).withColumn("parameter", F.regexp_replace("scenario", "[-+]", ""))
    return report(ev.stress_verdict(m, ["asset"], 0.8))


def variant_sql(variants: dict, select: str, *more: str) -> str:
    pairs = sorted({(f, w) for f, w, *_ in variants.values()})
    flags = ", ".join(f"coalesce(CASE WHEN rn >= {w - 1} THEN avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS {f - 1} PRECEDING) > avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS {w - 1} PRECEDING) END, FALSE) AS e_{f}_{w}" for f, w in pairs)
    pick = " ".join(f"WHEN '{n}' THEN e_{f}_{w}" for n, (f, w, *_) in variants.items())
    sig = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS rn FROM bars), flags AS (SELECT *, {flags} FROM numbered),
      sig AS (SELECT flags.*, scenario, CASE scenario {pick} END AS entry FROM flags, (VALUES {', '.join(f"('{n}')" for n in variants)}) z(scenario))"""
    case = lambda i, alias: "CASE " + alias + ".scenario " + " ".join(f"WHEN '{n}' THEN {v[i]}{'e0' if i < 5 else ''}" for n, v in variants.items()) + " END"
    return with_views("bars", sig, rows_sql("(VALUES (1e0, 1e0)) z(m, dir)"), exits_sql(case(2, "i"), case(3, "i"), case(5, "i")), walk_sql(alloc=case(4, "c")), MARKS, METRICS, *more, select=select)


SCREENED = {"original": (5, 20, 0.1, 0.2, 0.9, 20), "slower": (8, 30, 0.1, 0.2, 0.9, 20), "tighter": (5, 20, 0.06, 0.12, 0.9, 20)}


def variant_screen(s, d):
    m = backtest.run(variant_rows(s, d, SCREENED), ["asset", "scenario"], PARAMS).metrics().withColumnRenamed("scenario", "variant")
    return report(ev.variant_screen(m))


def viable(s, d):
    b = scenarios(trend_bars(s, d), {"long": {"direction": 1}, "short": {"direction": -1}})
    m = backtest.run(b, ["asset", "scenario"], PARAMS).metrics()
    return m.select("asset", "scenario", ev.viable(30).alias("viable"))


# ---- diagnostics ---------------------------------------------------------------------------

FEATURES = {
    "return_1": lambda c, o, h, lo: ta.pct(c, 1), "return_5": lambda c, o, h, lo: ta.pct(c, 5), "return_20": lambda c, o, h, lo: ta.pct(c, 20),
    "intraday_range": lambda c, o, h, lo: (h - lo) / c, "opening_gap": lambda c, o, h, lo: o / ta.lag(c, 1) - 1,
    "volatility_20": lambda c, o, h, lo: ta.std(ta.pct(c, 1), 20), "relative_volume_20": lambda c, o, h, lo: ta.number("volume") / ta.sma(ta.number("volume"), 20),
}


def feature_rows(s, d):
    args = [ta.number(n) for n in ("close", "open", "high", "low")]
    return stage(ta.evaluate(backtest.positioned(bars(s, d), KEYS), {n: f(*args) for n, f in FEATURES.items()}, KEYS, ["ts"], position="rn"))


FEATURE_SQL = """n0 AS (SELECT *, row_number() OVER w AS rn, close / lag(close) OVER w - 1 AS r1, close / lag(close, 5) OVER w - 1 AS r5, close / lag(close, 20) OVER w - 1 AS r20, (high - low) / close AS ir,
    open / lag(close) OVER w - 1 AS og, lead(open) OVER w AS nopen, lead(close, 1) OVER w AS c1, lead(close, 5) OVER w AS c5, lead(close, 20) OVER w AS c20 FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts)),
  n1 AS (SELECT *, CASE WHEN rn >= 21 THEN stddev_samp(r1) OVER g END AS v20, CASE WHEN rn >= 20 THEN volume / avg(volume) OVER g END AS rv FROM n0 WINDOW g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  pairs AS (SELECT asset, ts, h.horizon, CASE h.horizon WHEN 1 THEN c1 WHEN 5 THEN c5 ELSE c20 END / nopen - 1 AS fwd, f.feature,
    CASE f.feature WHEN 'return_1' THEN r1 WHEN 'return_5' THEN r5 WHEN 'return_20' THEN r20 WHEN 'intraday_range' THEN ir WHEN 'opening_gap' THEN og WHEN 'volatility_20' THEN v20 ELSE rv END AS value
    FROM n1, (VALUES (1), (5), (20)) h(horizon), (VALUES ('return_1'), ('return_5'), ('return_20'), ('intraday_range'), ('opening_gap'), ('volatility_20'), ('relative_volume_20')) f(feature)),
  good AS (SELECT * FROM pairs WHERE value IS NOT NULL AND fwd IS NOT NULL),
  q AS (SELECT asset, feature, horizon, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n, covar_samp(value, fwd) / (stddev_samp(value) * stddev_samp(fwd)) AS c FROM good GROUP BY 1, 2, 3)"""


def weekday_returns(s, d):
    p = ev.forward_pairs(backtest.positioned(bars(s, d), KEYS).withColumn("always", F.lit(1.0)), KEYS, ["always"])
    return report(p.filter("fwd IS NOT NULL").groupBy("asset", "horizon", F.weekday("ts").alias("weekday")).agg(
        F.count(F.lit(1)).alias("observations"), F.avg("fwd").alias("gross_return")))


def regime_breakdown(s, d):
    c = ta.number("close")
    rows = ta.evaluate(strategy_price(s, d), {"vol": ta.lag(ta.std(ta.pct(c, 1), 20), 1), "trend": ta.lag(ta.pct(c, 20), 1), "ret": ta.pct(c, 1)}, KEYS, ["ts"], position="rn")
    rows = stage(rows)
    n = sizes(rows)
    rows = rows.join(n, "asset")
    return report(ev.regime_breakdown(rows, KEYS, "vol", "trend", F.col("rn") < F.floor(F.col("n") * SPLIT)))


def strategy_price(s, d):
    return backtest.positioned(bars(s, d), KEYS)


def placebo_shift(s, d):
    rows = stage(trend_bars(s, d).withColumn("exit", ~F.col("entry")))
    rows = rows.join(sizes(rows).select("asset", F.floor(F.col("n") * SPLIT).alias("start")), "asset")
    p = stage(ev.shifted_signals(rows, KEYS, "start", 20))
    seg = p.select("asset", "start").distinct().join(sizes(rows), "asset").select("asset", F.lit("oos").alias("segment"), F.col("start").alias("seg_from"), F.col("n").alias("seg_to"))
    m = backtest.run(p.drop("start"), ["asset", "placebo"], PARAMS, segments=seg).metrics()
    return report(m.select("asset", "placebo", "net_return", "sharpe", "trades", "exposure", "turnover"))


PLACEBO_SIG = f"""sig0 AS (SELECT *, row_number() OVER w - 1 AS rn, coalesce(CASE WHEN count(*) OVER g = 20 THEN avg(close) OVER f > avg(close) OVER g END, FALSE) AS entry
  FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  cnt AS (SELECT asset, CAST(floor(count(*) * 0.6e0) AS BIGINT) AS st, count(*) - CAST(floor(count(*) * 0.6e0) AS BIGINT) AS tn FROM sig0 GROUP BY 1),
  moved AS (SELECT s.asset, p AS scenario, st + (rn - st + 1 + {draw_sql(42, 'p')} % (tn - 1)) % tn AS rn, entry AS e FROM sig0 s JOIN cnt USING (asset), range(20) z(p) WHERE rn >= st),
  sig AS (SELECT s.* EXCLUDE (entry), p AS scenario, coalesce(m.e, FALSE) AS entry, coalesce(NOT m.e, FALSE) AS leaves FROM sig0 s CROSS JOIN range(20) z(p) LEFT JOIN moved m ON m.asset = s.asset AND m.scenario = p AND m.rn = s.rn)"""


def causality_audit(s, d):
    rows = backtest.positioned(bars(s, d), KEYS)
    rules = {"trend": signals.entry("trend", 5, 20), "ema": signals.entry("ema_trend", 5, 20), "rsi": signals.entry("rsi_reversion", 5, 20)}
    return ev.causality_audit(rows, lambda df: ta.evaluate(df, rules, KEYS, ["ts"], position="rn"), KEYS, ["ts"], ["open", "high", "low", "close", "volume"], list(rules))


# 120 daily bars and 200 days: the first bar at or after both.
CONFIRMED = """k AS (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS k FROM bars),
  sp AS (SELECT asset, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1),
  due AS (SELECT sp.asset, CASE WHEN z >= a + INTERVAL 200 DAY THEN greatest(k.ts, a + INTERVAL 200 DAY) END AS due FROM sp LEFT JOIN k ON sp.asset = k.asset AND k.k = 120),
  confirmed AS (SELECT due.asset, min(b.ts) AS end_ts FROM due LEFT JOIN bars b ON b.asset = due.asset AND b.ts >= due.due GROUP BY 1)"""


def confirmation_end(s, d):
    b = bars(s, d)
    return report(ev.confirmation_end(b, KEYS, 86400, 86400, 200).withColumn("end_ts", F.coalesce("end_ts", F.lit("1970-01-01").cast("timestamp"))))


def forward_append(s, d):
    """History frozen at a date, then the same table again with later and restated rows."""
    b = bars(s, d).select("asset", "ts", "close")
    cut = F.lit("2000-01-01").cast("timestamp")
    incoming = b.withColumn("close", F.col("close") + 1).unionByName(b.filter(F.col("ts") >= F.lit("2001-01-01").cast("timestamp")).withColumn("close", F.col("close") + 2))
    return report(ev.forward_append(b.filter(F.col("ts") < cut), incoming, KEYS, "ts"))


def signal_fingerprint(s, d):
    rows = trend_bars(s, d).withColumn("exit", ~F.col("entry")).withColumn("decision", F.lit(True))
    return ev.signal_fingerprint(rows, KEYS, ["entry", "exit", "decision"])


def frozen_eval(s, d):
    """The one-shot evaluation: costs x1, x2, x3, benchmark, bootstrap and delay together."""
    rows = stage(trend_bars(s, d))
    seg = ranges_df(rows).filter("segment = 'oos'")
    costs = backtest.run(scenarios(rows, {f"x{m}": {"cost_multiplier": m} for m in (1, 2, 3)}), ["asset", "scenario"], PARAMS, segments=seg)
    m = costs.metrics()
    late = backtest.run(rows, KEYS, PARAMS, delay=1, segments=seg).metrics()
    base = m.filter("scenario = 'x1'")
    bench = ev.benchmark_compare(base, passive_oos(rows), KEYS).select("asset", F.col("passed").alias("benchmark_passed"))
    first = costs.rows.groupBy("asset").agg(F.min("rn").alias("_f"))
    oos = stage(costs.returns().filter("scenario = 'x1'").join(first, "asset").select("asset", (F.col("rn") - F.col("_f")).alias("rn"), "ret"))
    boot = ev.block_bootstrap(oos, KEYS).groupBy("asset").agg(F.min("passed").alias("bootstrap_passed"))
    stress = m.groupBy("asset").agg(F.min(ev.viable(20)).alias("costs_viable"))
    delayed = late.select("asset", ev.viable(20).alias("delay_viable"))
    j = base.select("asset", "net_return", "sharpe", "trades").join(stress, "asset").join(bench, "asset").join(boot, "asset", "left").join(delayed, "asset")
    j = j.fillna(False, ["bootstrap_passed"])
    return report(j.withColumn("passed", F.col("costs_viable") & F.col("benchmark_passed") & F.col("bootstrap_passed") & F.col("delay_viable")))


DAY = 86_400


def given_returns(s, d):
    """Daily returns of each asset."""
    from ..operators.blocks import with_previous

    r = with_previous(bars(s, d), KEYS, ["ts"], {"_c": "close"})
    return r.select("asset", "ts", (F.col("close") / F.col("_c") - 1).alias("ret"))


def given_trades(s, d):
    """Shipments read as positions: open from shipping for a day a piece, gaining what the discount is above 4.8 %."""
    t = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("asset")), "l_orderkey")
    return t.select("asset", F.col("l_shipdate").cast("timestamp").alias("entry_ts"), add_seconds(F.col("l_shipdate").cast("timestamp"), F.col("l_quantity").cast("long") * DAY).alias("exit_ts"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.048)).alias("pnl"))


def given_folds(s, d, holding_days: int = 20, count: int = FOLDS):
    b = bars(s, d).groupBy("asset").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    b = b.withColumn("split", floor_ts(F.timestamp_micros((F.unix_micros("start") + F.floor((F.unix_micros("end") - F.unix_micros("start")) * SPLIT)).cast("long")), DAY))
    return tf.time_folds(b, KEYS, count, DAY, holding_seconds=holding_days * DAY)


def time_folds(s, d):
    """Metrics of every training and test stretch, from given returns and trades."""
    return report(tf.fold_metrics(given_returns(s, d), given_trades(s, d), given_folds(s, d), KEYS, DAY).drop("curve"))


def time_walk_forward(s, d):
    return report(tf.walk_forward_in_time(given_returns(s, d), given_trades(s, d), given_folds(s, d), KEYS, DAY, FOLDS))


def short_history(s, d):
    """The same with so many folds that the tests are too short for evidence."""
    return report(tf.walk_forward_in_time(given_returns(s, d), given_trades(s, d), given_folds(s, d, count=60), KEYS, DAY, 60))


def time_folds_sql(select: str, count: int = FOLDS) -> str:
    return with_views("bars", f"""edge AS (SELECT asset, min(ts) AS a, date_trunc('day', make_timestamp(epoch_us(min(ts)) + CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) * 0.6e0) AS BIGINT))) AS s, max(ts) AS z FROM bars GROUP BY 1),
      cut AS (SELECT asset, a, f AS fold, date_diff('day', s, z) AS n, s + CAST(date_diff('day', s, z) * (f - 1) // {count} AS INTEGER) * INTERVAL 1 DAY AS t0, s + CAST(date_diff('day', s, z) * f // {count} AS INTEGER) * INTERVAL 1 DAY AS t1 FROM edge, range(1, {count + 1}) r(f)),
      seg AS (SELECT asset, fold, 'train' AS part, a AS lo, t0 - INTERVAL 20 DAY AS hi, date_diff('day', a, t0) - 20 >= 60 AND date_diff('day', t0, t1) >= 30 AS enough FROM cut
        UNION ALL SELECT asset, fold, 'test', t0, t1, date_diff('day', a, t0) - 20 >= 60 AND date_diff('day', t0, t1) >= 30 FROM cut),
      ret AS (SELECT * FROM (SELECT asset, ts, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
      curve AS (SELECT seg.*, ts, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY seg.asset, fold, part ORDER BY ts)) AS c FROM seg JOIN ret ON ret.asset = seg.asset AND ts > lo AND ts <= hi WHERE enough),
      peak AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY asset, fold, part ORDER BY ts)) AS top FROM curve),
      stat AS (SELECT asset, fold, part, count(*) AS periods, arg_max(c, ts) - 1 AS net_return, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0 END AS sharpe,
        greatest(0, max(1 - c / top)) AS max_drawdown, min(c) <= 0 AS bankrupt FROM peak GROUP BY 1, 2, 3),
      deal AS (SELECT o_orderpriority AS asset, CAST(l_shipdate AS TIMESTAMP) AS b, l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS e, l_extendedprice * (l_discount - 0.048e0) AS pnl FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      dealt AS (SELECT seg.asset, fold, part, count(*) FILTER (e <= hi) AS trades, coalesce(avg(pnl) FILTER (e <= hi), 0) AS expectancy, count(*) FILTER (e > hi) AS purged FROM seg JOIN deal ON deal.asset = seg.asset AND b >= lo AND b < hi WHERE enough GROUP BY 1, 2, 3),
      fm AS (SELECT asset, fold, part, periods, net_return, sharpe, max_drawdown, bankrupt, coalesce(trades, 0) AS trades, coalesce(expectancy, 0) AS expectancy, coalesce(purged, 0) AS purged FROM stat LEFT JOIN dealt USING (asset, fold, part)),
      ok AS (SELECT asset, fold, bool_and(NOT bankrupt AND net_return > 0 AND sharpe > 0 AND max_drawdown <= 0.25e0 AND trades >= CASE part WHEN 'train' THEN 30 ELSE {max(1, math.ceil(30 / count))} END) AND count(*) = 2 AS ok,
        sum(trades) FILTER (part = 'test') AS trades, sum(purged) AS purged, bool_or(part = 'test' AND (bankrupt OR max_drawdown > 0.25e0)) AS broken FROM fm GROUP BY 1, 2),
      joined AS (SELECT asset, ts, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY ts)) AS c FROM curve WHERE part = 'test'),
      jpeak AS (SELECT *, greatest(1, max(c) OVER (PARTITION BY asset ORDER BY ts)) AS top FROM joined),
      j AS (SELECT asset, arg_max(c, ts) - 1 AS net_return, greatest(0, max(1 - c / top)) AS max_drawdown FROM jpeak GROUP BY 1),
      tally AS (SELECT asset, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS passing_folds, sum(trades) AS trades, sum(purged) AS purged, bool_or(broken) AS broken FROM ok GROUP BY 1),
      every AS (SELECT asset, bool_and(enough) AS enough FROM seg GROUP BY 1)""", select=select)


TIME_VERDICT = """SELECT asset, CASE WHEN NOT enough THEN 'INSUFFICIENT_DATA' WHEN passing_folds >= {need} AND net_return > 0 AND max_drawdown <= 0.25e0 AND trades >= 30 AND NOT broken THEN 'PASSED' ELSE 'FAILED' END AS status,
  CASE WHEN enough THEN CAST(passing_folds AS BIGINT) END AS passing_folds, CASE WHEN enough THEN CAST(trades AS BIGINT) END AS trades, CASE WHEN enough THEN CAST(purged AS BIGINT) END AS purged,
  CASE WHEN enough THEN round(net_return, 6) END AS net_return, CASE WHEN enough THEN round(max_drawdown, 6) END AS max_drawdown FROM every LEFT JOIN tally USING (asset) LEFT JOIN j USING (asset)"""

def table_metrics(s, d):
    """Metrics of runs given as tables: equity from each asset's bids, trades from every fortieth of its events."""
    q = quotes(s, d).withColumn("n", F.col("sequence"))
    b = q.groupBy("asset").agg(F.min("ts").alias("start"), add_seconds(F.max("ts"), 1800).alias("end"), F.lit(1000.0).alias("capital"))
    equity = q.select("asset", "ts", "sequence", (1000 + 50 * (F.col("bid") - 101)).alias("equity"))
    quantity, gain = 1.0 + F.col("n") % 3, 0.1 * (F.col("n") % 11 - 5)
    t = q.filter(F.col("n") % 40 == 0).select("asset", F.col("ts").alias("entry_ts"), add_seconds(F.col("ts"), (F.col("n") % 7) * 3600).alias("exit_ts"), quantity.alias("quantity"),
                                              F.col("bid").alias("entry_price"), (F.col("bid") + gain).alias("exit_price"), (quantity * gain).alias("pnl"))
    return report(metrics.table_metrics(equity, t, b, KEYS, 3600, order=("ts", "sequence")))


TABLE_METRICS = with_views("quotes", """q AS (SELECT *, sequence AS n FROM quotes), b AS (SELECT asset, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z FROM q GROUP BY 1),
  eq AS (SELECT asset, ts, sequence, 1000 + 50 * (bid - 101) AS e FROM q),
  grid AS (SELECT asset, unnest(generate_series(date_trunc('hour', a) + INTERVAL 1 HOUR, date_trunc('hour', z - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS g FROM b),
  at_grid AS (SELECT grid.asset, g, coalesce(arg_max(e, (ts, sequence)), 1000) AS v FROM grid LEFT JOIN eq ON eq.asset = grid.asset AND ts < g GROUP BY 1, 2),
  r AS (SELECT asset, (v - coalesce(lag(v) OVER w, 1000)) / greatest(coalesce(lag(v) OVER w, 1000), 1e-12) AS ret FROM at_grid WINDOW w AS (PARTITION BY asset ORDER BY g)),
  sh AS (SELECT asset, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252e0) ELSE 0 END AS sharpe FROM r GROUP BY 1),
  pk AS (SELECT *, greatest(1000, max(e) OVER (PARTITION BY asset ORDER BY ts, sequence)) AS top FROM eq),
  rk AS (SELECT asset, arg_max(e, (ts, sequence)) AS fin, greatest(0, max(1 - e / top)) AS dd, min(e) <= 0 AS bankrupt FROM pk GROUP BY 1),
  t AS (SELECT asset, 1 + n % 3 AS k, bid, bid + 1e-1 * (n % 11 - 5) AS x, (1 + n % 3) * 1e-1 * (n % 11 - 5) AS pnl, (n % 7) * 3600 AS held FROM q WHERE n % 40 = 0),
  d AS (SELECT asset, count(*) AS trades, sum(greatest(pnl, 0)) AS gains, sum(-least(pnl, 0)) AS losses, avg(pnl) AS expectancy, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS hit, sum(k * (bid + x)) AS traded, sum(held) AS held FROM t GROUP BY 1)""",
    select="""SELECT b.asset, round(fin, 6) AS final_equity, round(fin / 1000 - 1, 6) AS net_return, round(sharpe, 6) AS sharpe, round(dd, 6) AS max_drawdown, bankrupt, coalesce(trades, 0) AS trades,
      round(CASE WHEN losses > 0 THEN gains / losses END, 6) AS profit_factor, coalesce(gains > 0 AND losses = 0, FALSE) AS no_losing_trades, round(coalesce(expectancy, 0), 6) AS expectancy, round(coalesce(hit, 0), 6) AS hit_rate,
      round(coalesce(held, 0) / ((epoch_us(z) - epoch_us(a)) / 1e6), 6) AS exposure, round(coalesce(traded, 0) / 1000, 6) AS turnover FROM b JOIN sh USING (asset) JOIN rk USING (asset) LEFT JOIN d USING (asset)""")

ROUND = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

QUERIES = {
    "hac_regression": (
        lambda s, d: report(ev.hac_regression(strategy_series(s, d), KEYS)),
        with_views("bars", TREND_SIGNAL, STRAT, HAC, select="""SELECT asset, n AS observations, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(se, 6) AS alpha_se, round(alpha / se, 6) AS alpha_z,
          round(alpha - 1.645e0 * se, 6) AS alpha_lower, round(1 - s11 / sst, 6) AS r_squared, lags AS hac_lags, alpha - 1.645e0 * se > 0 AS passed FROM u"""),
    ),
    "block_bootstrap": (
        lambda s, d: report(ev.block_bootstrap(strategy_series(s, d), KEYS)),
        with_views("bars", TREND_SIGNAL, STRAT, "sizes3 AS (SELECT asset, n, b FROM size, (VALUES (5), (10), (20)) z(b))", sampled("strat", "sizes3", 1000, "b"), PATHS,
                   select="""SELECT *, profit_probability >= 0.9e0 AND drawdown_p95 <= 0.25e0 AND ruin_probability <= 1e-2 AS passed FROM (SELECT asset, block, count(*) AS paths,
          round(avg(CASE WHEN profit > 0 THEN 1e0 ELSE 0e0 END), 6) AS profit_probability, round(quantile_cont(profit, 0.05), 6) AS return_p05, round(quantile_cont(profit, 0.5), 6) AS return_p50,
          round(quantile_cont(dd, 0.95), 6) AS drawdown_p95, round(avg(CASE WHEN low <= 5e-2 THEN 1e0 ELSE 0e0 END), 6) AS ruin_probability FROM paths GROUP BY 1, 2)"""),
    ),
    "mean_interval": (
        lambda s, d: report(ev.mean_interval(strategy_series(s, d), KEYS), 8),
        with_views("bars", TREND_SIGNAL, STRAT, sampled("strat", "size", 200, CUBE_ROOT), select="""SELECT asset, round(quantile_cont(m, 0.025), 8) AS lower, round(quantile_cont(m, 0.975), 8) AS upper, 'ESTIMATED' AS status
          FROM (SELECT asset, path, avg(ret) AS m FROM sample GROUP BY 1, 2) GROUP BY 1"""),
    ),
    "deflated_sharpe": (
        lambda s, d: report(ev.deflated_sharpe(strategy_series(s, d), KEYS, 100)),
        with_views("bars", TREND_SIGNAL, STRAT, *dsr_sql("strat", "size", 100), select=f"""SELECT asset, round(bench, 6) AS sr_benchmark, round(eff, 6) AS effective_observations, round(z, 6) AS dsr_z,
          round({normal.cdf_sql('z')}, 6) AS dsr, z >= {Z_MIN!r}::DOUBLE AS sequential_passed, round({Z_MIN!r}::DOUBLE, 6) AS sequential_z_min FROM dz"""),
    ),
    "concentration": (
        lambda s, d: report(ev.concentration(strategy_series(s, d), KEYS)),
        with_views("bars", TREND_SIGNAL, STRAT, """rk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY CASE WHEN ret > 0 THEN 0 ELSE 1 END, ret DESC, rn DESC) AS k FROM strat)""",
                   select="""SELECT asset, count(*) FILTER (k <= 5 AND ret > 0) AS removed_days, round(exp(sum(CASE WHEN k <= 5 AND ret > 0 THEN 0 ELSE ln(1 + ret) END)) - 1, 6) AS net_without_best,
          exp(sum(CASE WHEN k <= 5 AND ret > 0 THEN 0 ELSE ln(1 + ret) END)) - 1 > 0 AS passed FROM rk GROUP BY 1"""),
    ),
    "walk_forward": (
        walk_forward,
        segmented_sql("""SELECT asset, passing_folds, trades, round(net_return, 6) AS net_return, round(max_drawdown, 6) AS max_drawdown,
          passing_folds >= 2 AND net_return > 0 AND max_drawdown <= 0.25e0 AND trades >= 30 AND NOT broken AS passed FROM ft JOIN jd USING (asset)""", {**WINDOWS, **TRAINS}, WALK_TAIL),
    ),
    "time_folds": (time_folds, time_folds_sql(f"SELECT asset, CAST(fold AS INTEGER) AS fold, part, periods, {ROUND('net_return', 'sharpe', 'max_drawdown', 'expectancy')}, bankrupt, trades, purged FROM fm")),
    "table_metrics": (table_metrics, TABLE_METRICS),
    "time_walk_forward": (time_walk_forward, time_folds_sql(TIME_VERDICT.format(need=2))),
    "short_history": (short_history, time_folds_sql(TIME_VERDICT.format(need=40), 60)),
    "forward_windows": (
        forward_windows,
        segmented_sql("SELECT asset, count(*) FILTER (net_return > 0) AS positive_windows, round(min(net_return), 6) AS worst, round(max(net_return), 6) AS best FROM metrics GROUP BY 1", WINDOWS),
    ),
    "oos_degradation": (
        oos_degradation,
        segmented_sql("""SELECT i.asset, round(i.sharpe, 6) AS is_sharpe, round(o.sharpe, 6) AS oos_sharpe, round(CASE WHEN i.sharpe > 0 THEN greatest(0, 1 - o.sharpe / i.sharpe) ELSE 1 END, 6) AS degradation
          FROM metrics i JOIN metrics o ON i.asset = o.asset AND i.scenario = 'is' AND o.scenario = 'oos'""", IS_OOS),
    ),
    "benchmark_compare": (
        benchmark_compare,
        segmented_sql("""SELECT *, status = 'PASSED' AS passed FROM (SELECT o.asset, round(o.net_return, 6) AS net_return, round(o.sharpe, 6) AS sharpe, round(o.max_drawdown, 6) AS max_drawdown, o.trades,
          round(p.net_return, 6) AS passive_net_return, round(p.sharpe, 6) AS passive_sharpe, round(p.max_drawdown, 6) AS passive_max_drawdown, p.trades AS passive_trades,
          CASE WHEN p.trades = 0 THEN 'INSUFFICIENT_DATA' WHEN o.net_return > 0 AND o.trades > 0 AND o.sharpe > p.sharpe AND (o.net_return > p.net_return OR o.max_drawdown < p.max_drawdown) THEN 'PASSED' ELSE 'FAILED' END AS status
          FROM metrics o JOIN metrics p ON p.asset = o.asset AND p.scenario = 'passive' WHERE o.scenario = 'oos')""", {"oos": IS_OOS["oos"], "passive": IS_OOS["oos"]}, passive=True),
    ),
    "gate_report": (gate_report, segmented_sql(GATE_SELECT, GATE_RANGES, *GATE_TAIL, passive=True)),
    "gate_checklist": (
        gate_checklist,
        segmented_sql("""SELECT asset, i.label, round(i.value, 6) AS value, i.passed FROM (SELECT asset, unnest([
          {'label': 'dsr', 'value': dsr, 'passed': dsr >= 0.95e0}, {'label': 'dsr_z', 'value': dsr_z, 'passed': dsr_z > 1.2e0}, {'label': 'windows', 'value': positive_windows::DOUBLE, 'passed': positive_windows >= 2},
          {'label': 'is_sharpe', 'value': is_sharpe, 'passed': is_sharpe > 0}, {'label': 'is_trades', 'value': is_trades::DOUBLE, 'passed': is_trades >= 30}, {'label': 'is_drawdown', 'value': is_dd, 'passed': is_dd <= 0.25e0}, {'label': 'is_return', 'value': is_ret, 'passed': is_ret > 0},
          {'label': 'oos_sharpe', 'value': oos_sharpe, 'passed': oos_sharpe > 0}, {'label': 'oos_trades', 'value': oos_trades::DOUBLE, 'passed': oos_trades >= 30}, {'label': 'oos_drawdown', 'value': oos_dd, 'passed': oos_dd <= 0.25e0}, {'label': 'oos_return', 'value': oos_ret, 'passed': oos_ret > 0}]) AS i FROM gates)""",
                      GATE_RANGES, *GATE_TAIL, passive=True),
    ),
    "param_stress": (
        param_stress,
        variant_sql(VARIANTS, f"""SELECT asset, count(*) FILTER (NOT j) AS singles, round(avg(CASE WHEN v THEN 1e0 ELSE 0e0 END) FILTER (NOT j), 6) AS single_fraction, count(*) FILTER (j) AS joints,
          round(avg(CASE WHEN v THEN 1e0 ELSE 0e0 END) FILTER (j), 6) AS joint_fraction, count(DISTINCT regexp_replace(scenario, '[-+]', '')) FILTER (NOT j) AS parameters,
          avg(CASE WHEN v THEN 1e0 ELSE 0e0 END) FILTER (NOT j) >= 0.8e0 AND avg(CASE WHEN v THEN 1e0 ELSE 0e0 END) FILTER (j) >= 0.8e0 AS passed
          FROM (SELECT asset, scenario, scenario LIKE 'joint%' AS j, {VIABLE.format(dd=0.25, n=30)} AS v FROM metrics) GROUP BY 1"""),
    ),
    "variant_screen": (
        variant_screen,
        variant_sql(SCREENED, "SELECT v.variant, round(v.score, 6) AS score, round(o.score, 6) AS original_score, v.score > o.score AS passed FROM sc v, sc o WHERE o.variant = 'original' AND v.variant <> 'original'",
                    "sc AS (SELECT scenario AS variant, quantile_cont(CASE WHEN trades >= 30 THEN sharpe ELSE -1000e0 END, 0.5) AS score FROM metrics GROUP BY 1)"),
    ),
    "viable": (
        viable,
        run_sql(f"SELECT asset, scenario, {VIABLE.format(dd=0.25, n=30)} AS viable FROM metrics", "(VALUES ('long', 1e0, 1e0), ('short', 1e0, -1e0)) z(scenario, m, dir)", metrics=True),
    ),
    "forward_means": (
        lambda s, d: report(ev.forward_means(trend_bars(s, d), KEYS)),
        with_views("bars", TREND_SIGNAL, """f AS (SELECT asset, entry, h.horizon, CASE h.horizon WHEN 1 THEN o1 WHEN 5 THEN o5 ELSE o20 END / o0 - 1 AS fwd FROM (
            SELECT *, lead(open, 1) OVER w AS o0, lead(open, 2) OVER w AS o1, lead(open, 6) OVER w AS o5, lead(open, 21) OVER w AS o20 FROM sig WINDOW w AS (PARTITION BY asset ORDER BY ts)), (VALUES (1), (5), (20)) h(horizon))""",
                   select="SELECT asset, horizon, count(*) FILTER (entry) AS events, round(avg(fwd) FILTER (entry), 6) AS conditional_mean, round(avg(fwd), 6) AS unconditional_mean FROM f WHERE fwd IS NOT NULL GROUP BY 1, 2"),
    ),
    "feature_associations": (
        lambda s, d: report(ev.feature_associations(ev.forward_pairs(feature_rows(s, d), KEYS, list(FEATURES)), KEYS)),
        with_views("bars", FEATURE_SQL, select="""SELECT asset, feature, horizon, first(q.n) AS observations, round(first(q.c), 6) AS correlation, round(avg(fwd) FILTER (value <= q1), 6) AS low_quartile_return,
          round(avg(fwd) FILTER (value >= q3), 6) AS high_quartile_return FROM good JOIN q USING (asset, feature, horizon) WHERE q.n >= 60 GROUP BY 1, 2, 3"""),
    ),
    "weekday_returns": (
        weekday_returns,
        with_views("bars", FEATURE_SQL, select="SELECT asset, horizon, isodow(ts) - 1 AS weekday, count(*) AS observations, round(avg(fwd), 6) AS gross_return FROM pairs WHERE feature = 'return_1' AND fwd IS NOT NULL GROUP BY 1, 2, 3"),
    ),
    "regime_breakdown": (
        regime_breakdown,
        with_views("bars", FEATURE_SQL, """lg AS (SELECT asset, rn, r1 AS ret, lag(v20) OVER w AS vol, lag(r20) OVER w AS trend, count(*) OVER (PARTITION BY asset) AS n FROM n1 WINDOW w AS (PARTITION BY asset ORDER BY ts)),
          th AS (SELECT asset, median(vol) AS t FROM lg WHERE rn - 1 < floor(n * 0.6e0) GROUP BY 1),
          lab AS (SELECT asset, ret, unnest([CASE WHEN vol > t THEN 'high_volatility' WHEN vol <= t THEN 'low_volatility' END, CASE WHEN trend > 0 THEN 'uptrend' WHEN trend < 0 THEN 'downtrend' END]) AS regime
            FROM lg JOIN th USING (asset) WHERE rn - 1 >= floor(n * 0.6e0))""",
                   select="SELECT asset, regime, count(*) AS bars, round(avg(ret), 6) AS mean_return, round(exp(sum(ln(1 + ret))) - 1, 6) AS compounded_return FROM lab WHERE regime IS NOT NULL GROUP BY 1, 2"),
    ),
    "placebo_shift": (
        placebo_shift,
        with_views("bars", PLACEBO_SIG, rows_sql("(VALUES (1e0, 1e0)) z(m, dir)", exit_expr="leaves", segment="rn >= (SELECT st FROM cnt WHERE cnt.asset = lagged.asset)"),
                   exits_sql(), walk_sql(), MARKS, METRICS, select=f"SELECT asset, scenario AS placebo, {ROUND('net_return', 'sharpe', 'exposure', 'turnover')}, trades FROM metrics"),
    ),
    "causality_audit": (
        causality_audit,
        with_views("bars", "n AS (SELECT asset, count(*) AS n FROM bars GROUP BY 1)", select="""SELECT cut, CAST(sum(floor(n * cut)) AS BIGINT) AS compared, 0 AS changed, TRUE AS passed FROM n, (VALUES (0.5e0), (0.75e0)) z(cut) GROUP BY 1"""),
    ),
    "confirmation_end": (
        confirmation_end,
        with_views("bars", CONFIRMED, select="SELECT asset, coalesce(end_ts, TIMESTAMP '1970-01-01') AS end_ts FROM confirmed"),
    ),
    "forward_append": (
        forward_append,
        with_views("bars", "l AS (SELECT asset, max(ts) AS last FROM bars WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1)",
                   select="SELECT asset, ts, round(CASE WHEN ts > last THEN close + 1 ELSE close END, 6) AS close, ts > last AS appended FROM bars JOIN l USING (asset)"),
    ),
    "signal_fingerprint": (
        signal_fingerprint,
        with_views("bars", TREND_SIGNAL, """h AS (SELECT asset, sha256(rn::VARCHAR || ':' || CASE WHEN entry THEN '101' ELSE '011' END) AS x FROM sig)""",
                   select="""SELECT asset, sha256(concat_ws('|', count(*)::VARCHAR, sum(('0x' || x[1:15])::BIGINT)::VARCHAR, sum(('0x' || x[16:30])::BIGINT)::VARCHAR,
          sum(('0x' || x[31:45])::BIGINT)::VARCHAR, sum(('0x' || x[46:60])::BIGINT)::VARCHAR)) AS fingerprint FROM h GROUP BY 1"""),
    ),
    "frozen_eval": (frozen_eval, None),
}
