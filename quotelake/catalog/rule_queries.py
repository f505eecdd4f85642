"""Registered rule functions and signal families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import signals, ta
from ..operators import resample as rs
from ..plans.inputs import bars, quotes, report
from ..plans.trend import trend_fills
from .common import with_views
from .time_queries import H4, MID, ohlc

SERIES = """s AS (SELECT asset, ts, sequence, row_number() OVER (PARTITION BY asset ORDER BY ts, sequence) AS rn,
    CASE WHEN sequence % 13 = 4 THEN NULL ELSE (bid + ask) / 2 END AS x,
    CASE WHEN sequence % 17 = 5 THEN NULL ELSE round((ask - bid) * 100) END AS y FROM quotes)"""
OVER = "WINDOW w AS (PARTITION BY asset ORDER BY ts, sequence)"


def series(s, d):
    """Quotes with a mid price and a spread in cents, both with missing values."""
    n = F.col("sequence")
    return quotes(s, d).select(
        "asset", "ts", "sequence",
        F.when(n % 13 != 4, (F.col("bid") + F.col("ask")) / 2).alias("x"),
        F.when(n % 17 != 5, F.round((F.col("ask") - F.col("bid")) * 100)).alias("y"),
    )


def rule(make: Callable[[ta.Feature, ta.Feature], ta.Feature]):
    def query(s, d):
        f = make(ta.number("x"), ta.number("y"))
        out = ta.evaluate(series(s, d), {"value": f}, ["asset"], ["ts", "sequence"])
        return report(out.select("asset", "sequence", "value"))

    return query


def rule_sql(value: str, window: str = OVER) -> str:
    return with_views("quotes", SERIES, select=f"SELECT asset, sequence, {value} AS value FROM s {window}")


def framed(agg: str, n: int) -> str:
    return rule_sql(f"round(CASE WHEN count(x) OVER f = {n} THEN {agg} OVER f END, 6)", OVER + f", f AS (PARTITION BY asset ORDER BY ts, sequence ROWS {n - 1} PRECEDING)")


def ema_ctes(source: str, x: str, n: int, name: str = "e") -> str:
    a, q = f"(2e0 / {n + 1})", f"(1 - 2e0 / {n + 1})"
    return f"""{name} AS (
    SELECT asset, rn, {x} AS m, 1e0 AS w, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS obs FROM {source} WHERE rn = 1
    UNION ALL
    SELECT n.asset, n.rn, CASE WHEN r.m IS NULL THEN n.{x} WHEN n.{x} IS NULL THEN r.m ELSE (r.w * {q} * r.m + {a} * n.{x}) / (r.w * {q} + {a}) END,
      CASE WHEN n.{x} IS NULL AND r.m IS NOT NULL THEN r.w * {q} ELSE 1e0 END, r.obs + CASE WHEN n.{x} IS NULL THEN 0 ELSE 1 END
    FROM {name} r JOIN {source} n ON n.asset = r.asset AND n.rn = r.rn + 1)"""


FRAME5 = OVER + ", f AS (PARTITION BY asset ORDER BY ts, sequence ROWS 4 PRECEDING)"
PAIRS = """p AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS b FROM s)"""


LONG = 300
FILLED = "z AS (SELECT *, coalesce(x, 100e0) AS z FROM s)"


def filled(x: ta.Feature) -> ta.Feature:
    """Missing prices read as 100, so that long windows are full."""
    return ta.Feature(lambda s: F.coalesce(x.make(s), F.lit(100.0)))


def long_sql(agg: str) -> str:
    over = f"{OVER}, f AS (PARTITION BY asset ORDER BY ts, sequence ROWS {LONG - 1} PRECEDING)"
    return with_views("quotes", SERIES, FILLED, select=f"SELECT asset, sequence, round(CASE WHEN rn >= {LONG} THEN {agg} OVER f END, 6) AS value FROM z {over}")


def family(name: str, fast: int = 5, slow: int = 20, threshold: float = 1.0, **kw):
    def query(s, d):
        f = signals.entry(name, fast, slow, threshold, **kw)
        return report(ta.evaluate(bars(s, d), {"entry": f}, ["asset"], ["ts"]).select("asset", "ts", "entry"))

    return query


def one(feature: Callable[[], ta.Feature]):
    def query(s, d):
        return report(ta.evaluate(bars(s, d), {"entry": ta.signal(feature())}, ["asset"], ["ts"]).select("asset", "ts", "entry"))

    return query


FAMILY_BASE = """n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn FROM bars),
  i AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER f END AS fast, CASE WHEN rn >= 20 THEN avg(close) OVER g END AS slow,
    CASE WHEN rn >= 20 THEN stddev_samp(close) OVER g END AS sd, CASE WHEN rn >= 20 THEN max(high) OVER g END AS top,
    close - lag(close) OVER w AS move, close / lag(close, 20) OVER w - 1 AS ret20, close / lag(close) OVER w - 1 AS ret
    FROM n WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  j AS (SELECT *, CASE WHEN count(move) OVER f = 5 THEN avg(greatest(move, 0)) OVER f END AS gain, CASE WHEN count(move) OVER f = 5 THEN avg(-least(move, 0)) OVER f END AS loss,
    CASE WHEN count(ret) OVER f = 5 THEN stddev_samp(ret) OVER f END AS sf, CASE WHEN count(ret) OVER g = 20 THEN stddev_samp(ret) OVER g END AS sg, lag(top) OVER w AS prior_top
    FROM i WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS 4 PRECEDING), g AS (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING)),
  k AS (SELECT *, lag(sf) OVER w AS psf, lag(sg) OVER w AS psg FROM j WINDOW w AS (PARTITION BY asset ORDER BY ts))"""


def family_sql(condition: str) -> str:
    return with_views("bars", FAMILY_BASE, select=f"SELECT asset, ts, coalesce({condition}, FALSE) AS entry FROM k")


QUERIES = {
    "rule_arithmetic": (rule(lambda x, y: -(x + y) * 2 - y + +x), rule_sql("round(-(x + y) * 2 - y + x, 6)")),
    "rule_divide": (rule(lambda x, y: x / (y - 3)), rule_sql("round(x / nullif(y - 3, 0), 6)")),
    "rule_compare": (
        rule(lambda x, y: ta.where((y != 2) & (y >= 1) & (y < 5), 1.0, 0.0)),
        rule_sql("CASE WHEN y <> 2 AND y >= 1 AND y < 5 THEN 1e0 WHEN NOT (y <> 2 AND y >= 1 AND y < 5) THEN 0e0 END"),
    ),
    "rule_logic": (
        rule(lambda x, y: ta.signal((x > 101) | ~((y <= 2) & (x == x)))),
        rule_sql("coalesce(x > 101 OR NOT (y <= 2 AND x = x), FALSE)"),
    ),
    "rule_lag": (rule(lambda x, y: ta.lag(x, 3)), rule_sql("round(lag(x, 3) OVER w, 6)")),
    "rule_change": (rule(lambda x, y: ta.change(x, 2)), rule_sql("round(x - lag(x, 2) OVER w, 6)")),
    "rule_pct": (rule(lambda x, y: ta.pct(y - 3, 2)), rule_sql("round((y - 3) / nullif(lag(y - 3, 2) OVER w, 0) - 1, 6)")),
    "rule_sma": (rule(lambda x, y: ta.sma(x, 5)), framed("avg(x)", 5)),
    "rule_std": (rule(lambda x, y: ta.std(x, 5)), framed("stddev_samp(x)", 5)),
    "rule_lowest": (rule(lambda x, y: ta.lowest(x, 7)), framed("min(x)", 7)),
    "rule_highest": (rule(lambda x, y: ta.highest(x, 7)), framed("max(x)", 7)),
    "rule_total": (rule(lambda x, y: ta.total(x, 4)), framed("sum(x)", 4)),
    "rule_ema": (
        rule(lambda x, y: ta.ema(x, 8)),
        with_views("quotes", SERIES, ema_ctes("s", "x", 8), select="SELECT asset, sequence, round(CASE WHEN obs >= 8 THEN m END, 6) AS value FROM e JOIN s USING (asset, rn)"),
    ),
    "rule_rank": (
        rule(lambda x, y: ta.rank(y, 5)),
        rule_sql("round(CASE WHEN count(y) OVER f = 5 THEN (len(list_filter(list(y) OVER f, lambda v: v < y)) + (len(list_filter(list(y) OVER f, lambda v: v = y)) + 1) / 2) / 5 END, 6)", FRAME5),
    ),
    "rule_quantile": (rule(lambda x, y: ta.quantile(x, 6, 0.3)), framed("quantile_cont(x, 0.3)", 6)),
    "rule_corr": (
        rule(lambda x, y: ta.corr(x, y, 5)),
        with_views("quotes", SERIES, PAIRS, select="""SELECT asset, sequence, round(CASE WHEN count(a) OVER f = 5 AND min(a) OVER f < max(a) OVER f AND min(b) OVER f < max(b) OVER f
          THEN covar_samp(a, b) OVER f / (stddev_samp(a) OVER f * stddev_samp(b) OVER f) END, 6) AS value FROM p """ + FRAME5),
    ),
    # windows of half a thousand rows: constant or logarithmic work a row
    "rule_long_mean": (rule(lambda x, y: ta.sma(filled(x), LONG)), long_sql("avg(z)")),
    "rule_long_std": (rule(lambda x, y: ta.std(filled(x), LONG)), long_sql("stddev_samp(z)")),
    "rule_long_total": (rule(lambda x, y: ta.total(filled(x), LONG)), long_sql("sum(z)")),
    "rule_long_range": (rule(lambda x, y: ta.highest(filled(x), LONG) - ta.lowest(filled(x), LONG)), long_sql("max(z) OVER f - min(z)")),
    "rule_long_corr": (rule(lambda x, y: ta.corr(filled(x), filled(y), LONG)), with_views(
        "quotes", SERIES, "p AS (SELECT *, coalesce(x, 100e0) AS a, coalesce(y, 100e0) AS b FROM s)", select=f"""SELECT asset, sequence, round(CASE WHEN count(a) OVER f = {LONG} AND min(a) OVER f < max(a) OVER f AND min(b) OVER f < max(b) OVER f
          THEN covar_samp(a, b) OVER f / (stddev_samp(a) OVER f * stddev_samp(b) OVER f) END, 6) AS value FROM p """ + OVER + f", f AS (PARTITION BY asset ORDER BY ts, sequence ROWS {LONG - 1} PRECEDING)")),
    "rule_long_rank": (
        rule(lambda x, y: ta.rank(filled(x), LONG)),
        with_views("quotes", SERIES, FILLED, select=f"""SELECT asset, sequence, round(CASE WHEN rn >= {LONG} THEN
          (list_aggregate([CASE WHEN v < z THEN 1 ELSE 0 END FOR v IN w], 'sum') + (list_aggregate([CASE WHEN v = z THEN 1 ELSE 0 END FOR v IN w], 'sum') + 1) / 2) / {LONG} END, 6) AS value
          FROM (SELECT *, list(z) OVER (PARTITION BY asset ORDER BY ts, sequence ROWS {LONG - 1} PRECEDING) AS w FROM z)"""),
    ),
    "rule_long_quantile": (rule(lambda x, y: ta.quantile(filled(x), LONG, 0.3)), long_sql("quantile_cont(z, 0.3)")),
    "rule_abs": (rule(lambda x, y: ta.absolute(100.5 - x)), rule_sql("round(abs(100.5e0 - x), 6)")),
    "rule_log": (rule(lambda x, y: ta.log(y - 3)), rule_sql("round(CASE WHEN y - 3 > 0 THEN ln(y - 3) END, 6)")),
    "rule_sqrt": (rule(lambda x, y: ta.sqrt(y - 3)), rule_sql("round(CASE WHEN y - 3 >= 0 THEN sqrt(y - 3) END, 6)")),
    "rule_where": (rule(lambda x, y: ta.where(y > 2, x, -y)), rule_sql("round(CASE WHEN y > 2 THEN x WHEN NOT y > 2 THEN -y END, 6)")),
    "rule_nested": (
        rule(lambda x, y: ta.change(ta.sma(ta.lag(x, 1), 3), 2) / ta.std(ta.highest(x, 2), 4)),
        with_views("quotes", SERIES, """t AS (SELECT *, lag(x) OVER w AS l, CASE WHEN count(x) OVER (w ROWS 1 PRECEDING) = 2 THEN max(x) OVER (w ROWS 1 PRECEDING) END AS h FROM s WINDOW w AS (PARTITION BY asset ORDER BY ts, sequence)),
          u AS (SELECT *, CASE WHEN count(l) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(l) OVER (w ROWS 2 PRECEDING) END AS m,
            CASE WHEN count(h) OVER (w ROWS 3 PRECEDING) = 4 THEN stddev_samp(h) OVER (w ROWS 3 PRECEDING) END AS sd FROM t WINDOW w AS (PARTITION BY asset ORDER BY ts, sequence))""",
                   select="SELECT asset, sequence, round((m - lag(m, 2) OVER (PARTITION BY asset ORDER BY ts, sequence)) / nullif(sd, 0), 6) AS value FROM u"),
    ),
    "sig_trend": (family("trend"), family_sql("fast > slow")),
    "sig_mean_reversion": (family("mean_reversion", threshold=0.7), family_sql("(close - slow) / nullif(sd, 0) < -0.7e0")),
    "sig_breakout": (family("breakout"), family_sql("close > prior_top")),
    "sig_momentum": (family("momentum", threshold=1.5), family_sql("ret20 > 1.5e0 / 100")),
    "sig_dip": (family("dip"), family_sql("close > slow AND close < fast")),
    "sig_ema_trend": (
        family("ema_trend"),
        with_views("bars", FAMILY_BASE, ema_ctes("n", "close", 5, "e5"), ema_ctes("n", "close", 20, "e20"),
                   select="SELECT n.asset, n.ts, coalesce(CASE WHEN e5.obs >= 5 AND e20.obs >= 20 THEN e5.m > e20.m END, FALSE) AS entry FROM n JOIN e5 USING (asset, rn) JOIN e20 USING (asset, rn)"),
    ),
    "sig_rsi": (family("rsi_reversion"), family_sql("100 * gain / nullif(gain + loss, 0) < 40 AND close > slow")),
    "sig_vol_breakout": (family("volatility_breakout", threshold=0.8), family_sql("close > slow + 0.8e0 * sd")),
    "sig_regime": (
        family("trend", regime_name="low_volatility", confirmation="strong_close"),
        family_sql("fast > slow AND psf < psg AND (close - low) / nullif(high - low, 0) >= 0.75e0"),
    ),
    "sig_uptrend": (family("breakout", regime_name="uptrend"), family_sql("close > prior_top AND close > slow")),
    "sig_strong_close": (one(signals.strong_close), family_sql("(close - low) / nullif(high - low, 0) >= 0.75e0")),
    "trend_fills": (
        lambda s, d: report(trend_fills(quotes(s, d), H4, 3, 8)),
        with_views("quotes", f"b AS ({ohlc(H4, MID)})", """r AS (SELECT *, row_number() OVER w AS rn, avg(close) OVER (w ROWS 2 PRECEDING) AS f, avg(close) OVER (w ROWS 7 PRECEDING) AS g,
            lead(open) OVER w AS fill FROM (SELECT b.* FROM b JOIN (SELECT asset, min(ts) AS first FROM quotes GROUP BY 1) USING (asset) WHERE ts >= first) WINDOW w AS (PARTITION BY asset ORDER BY ts)),
          e AS (SELECT *, rn >= 8 AND f > g AS on_now, coalesce(lag(rn >= 8 AND f > g) OVER (PARTITION BY asset ORDER BY ts), FALSE) AS on_before FROM r)""",
                   select="SELECT asset, count(*) AS fills, round(avg(fill * (1 + 6e-4)), 6) AS mean_price FROM e WHERE on_now AND NOT on_before AND fill IS NOT NULL GROUP BY 1"),
    ),
}
