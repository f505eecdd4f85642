"""Run metrics from equity marks and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import micros, ratio
from . import blocks

TINY = 1e-12


def returns(curve: DataFrame, keys: list[str], value: str = "equity", initial: str = "capital", order: tuple[str, ...] = ("ts",),
            block_rows: int = blocks.BLOCK_ROWS, position: str | None = None) -> DataFrame:
    """Per-row return; the first row is measured against the initial capital."""
    r = blocks.with_previous(curve, keys, list(order), {"_before": value}, block_rows=block_rows, position=position)
    before = F.coalesce("_before", F.col(initial))
    return r.withColumn("ret", (F.col(value) - before) / F.greatest(before, F.lit(TINY))).drop("_before")


def running_peak(curve: DataFrame, keys: list[str], value: str = "equity", initial: str = "capital",
                 block_rows: int = blocks.BLOCK_ROWS, position: str | None = None) -> DataFrame:
    """Highest value so far (``peak``) and before this row (``prior_peak``), capital included."""
    b = blocks.split(curve, keys, ["ts"], block_rows=block_rows, position=position)
    rows = blocks.carried(b, {"_top": F.max(value)}, {"_top": "max"})
    run = b.window().rowsBetween(Window.unboundedPreceding, 0)
    past = b.window().rowsBetween(Window.unboundedPreceding, -1)
    return b.own(rows.withColumns({
        "peak": F.greatest(F.col(initial), F.col("_top"), F.max(value).over(run)),
        "prior_peak": F.greatest(F.col(initial), F.col("_top"), F.max(value).over(past)),
    })).drop("_top")


def sharpe(ret: Column, bars_per_year: float | Column) -> Column:
    sd = F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    year = bars_per_year if isinstance(bars_per_year, Column) else F.lit(float(bars_per_year))
    return F.when(sd > TINY, F.avg(ret) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.max(year))).otherwise(F.lit(0.0))


def run_metrics(marks: DataFrame, ledger: DataFrame, keys: list[str], bars_per_year: float = 252.0, block_rows: int = blocks.BLOCK_ROWS, position: str | None = None) -> DataFrame:
    """One row per run: return, risk, trade statistics. ``position`` names the marks' gapless positions, if they have them."""
    curve = running_peak(returns(marks, keys, block_rows=block_rows, position=position), keys, block_rows=block_rows, position=position)
    inner = F.when(F.col("worst").isNotNull(), 1 - F.col("worst") / F.greatest(F.col("prior_peak"), F.lit(TINY)))
    risk = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.max("capital").alias("capital"),
        sharpe(F.col("ret"), bars_per_year).alias("sharpe"),
        F.max_by("equity", "ts").alias("final_equity"),
        F.max(1 - F.col("equity") / F.col("peak")).alias("max_drawdown"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(inner), F.lit(0.0))).alias("intrabar_drawdown"),
        F.min("equity").alias("_least"),
        (F.sum(F.col("held").cast("double")) / F.count(F.lit(1))).alias("exposure"),
    )
    t = F.col("kind") == "trade"
    pnl = F.when(t, F.col("pnl"))
    deals = ledger.groupBy(*keys).agg(
        F.count(F.when(t, 1)).alias("trades"),
        F.count(F.when(~t, 1)).alias("skipped_orders"),
        F.sum(F.greatest(pnl, F.lit(0.0))).alias("_gains"),
        F.sum(-F.least(pnl, F.lit(0.0))).alias("_losses"),
        F.avg(pnl).alias("expectancy"),
        F.avg((pnl > 0).cast("double")).alias("hit_rate"),
        F.sum(F.when(t, F.col("quantity") * (F.col("entry_price") + F.col("exit_price")))).alias("_traded"),
    )
    j = risk.join(deals, keys, "left").fillna(0, ["trades", "skipped_orders", "_gains", "_losses", "_traded"])
    j = j.fillna(0.0, ["expectancy", "hit_rate"])
    gains, losses = F.col("_gains"), F.col("_losses")
    return j.withColumns({
        "net_return": F.col("final_equity") / F.col("capital") - 1,
        "max_drawdown": F.greatest(F.lit(0.0), F.col("max_drawdown")),
        "profit_factor": F.when(losses > 0, ratio(gains, losses)).when(gains > 0, F.lit(None)).otherwise(F.lit(0.0)),
        "no_losing_trades": (gains > 0) & (losses == 0),
        "bankrupt": (F.col("_least") <= 0) | (F.col("intrabar_drawdown") >= 1),
        "turnover": F.col("_traded") / F.col("capital"),
    }).drop("_gains", "_losses", "_traded", "_least", "capital")


def compound(ret: Column) -> Column:
    """prod(1 + r) - 1; a return of -100 % or worse is total loss."""
    safe = F.when(ret > -1, F.ln(1 + ret))
    return F.when(F.min(ret) <= -1, F.lit(-1.0)).otherwise(F.exp(F.coalesce(F.sum(safe), F.lit(0.0))) - 1)


def baseline_delta(metrics: DataFrame, keys: list[str], scenario: str, baseline: str) -> DataFrame:
    """Net return and Sharpe of each scenario less the baseline scenario's."""
    base = metrics.filter(F.col(scenario) == baseline).select(*keys, F.col("net_return").alias("_r"), F.col("sharpe").alias("_s"))
    return metrics.filter(F.col(scenario) != baseline).join(base, keys).select(
        *keys, scenario, (F.col("net_return") - F.col("_r")).alias("net_return_difference"),
        (F.col("sharpe") - F.col("_s")).alias("sharpe_difference"),
    )


def grid_returns(equity: DataFrame, bounds: DataFrame, keys: list[str], grid: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """keys, ``boundary``, ``equity`` and ``ret`` at the grid boundaries before which an equity table has a mark; at all others the return is zero.

    ``equity``: keys, the columns ``order`` (the first is the time) and ``equity``. ``bounds``: keys, start, end, capital. A boundary sees the last mark strictly before it,
    so a mark on a boundary belongs to the next interval; the first return is against the capital. Boundaries are numbered from 1, the
    first after ``start``; ``intervals`` is how many there are up to ``end``. The calendar itself is never made: a mark names the boundary that sees it.
    """
    us = F.lit(grid * 1_000_000)
    below = lambda c: ((micros(F.col(c)) - F.pmod(micros(F.col(c)), us)) / us).cast("long")
    above = F.ceil(micros(F.col("end")) / us).cast("long")
    limits = bounds.select(*keys, "capital", below("start").alias("_first"), (above - below("start")).alias("intervals"))
    seen = blocks.null_safe_join(equity, limits, keys, "inner").withColumn("boundary", below(order[0]) + 1 - F.col("_first"))
    seen = seen.filter((F.col("boundary") >= 1) & (F.col("boundary") <= F.col("intervals")))
    last = seen.groupBy(*keys, "boundary").agg(F.max_by("equity", F.struct(*order)).alias("equity"), F.max("capital").alias("capital"), F.max("intervals").alias("intervals"))
    r = blocks.with_previous(last, keys, ["boundary"], {"_before": "equity"}, slot=F.floor(F.col("boundary") / 4096))
    before = F.coalesce("_before", "capital")
    return r.withColumn("ret", (F.col("equity") - before) / F.greatest(before, F.lit(TINY))).drop("_before")


def table_metrics(equity: DataFrame, trades: DataFrame, bounds: DataFrame, keys: list[str], grid: int, periods_per_year: float = 252.0, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Metrics of runs that are given as tables: an equity table on any time line, trades, and the bounds of each run. One row per run in ``bounds``.

    Return and Sharpe ratio are of the returns on the grid (:func:`grid_returns`), drawdown and ruin of every mark. The profit factor is missing without a loss. Marks outside of
    [start, end) do not count; a run without marks keeps its capital, and one without trades has zeros.
    """
    curve = blocks.null_safe_join(equity, bounds.select(*keys, "start", "end", "capital"), keys, "inner")
    curve = curve.filter((F.col(order[0]) >= F.col("start")) & (F.col(order[0]) < F.col("end")))
    r = grid_returns(curve.drop("start", "end", "capital"), bounds, keys, grid, order)
    n, m, mean = F.max("intervals"), F.count(F.lit(1)), F.avg("ret")
    # the other intervals return zero: both parts' moments are put together
    moments = r.groupBy(*keys).agg((F.sum("ret") / n).alias("_mean"), (F.var_pop("ret") * m + mean * mean * m * (n - m) / n).alias("_m2"), n.alias("_n"))
    sd = F.sqrt(F.col("_m2") / F.nullif(F.col("_n") - 1, F.lit(0)))
    moments = moments.select(*keys, F.when(sd > TINY, F.col("_mean") / F.nullif(sd, F.lit(0.0)) * (periods_per_year**0.5)).otherwise(0.0).alias("sharpe"))
    b = blocks.split(curve, keys, list(order))
    peaks = blocks.carried(b, {"_top": F.max("equity")}, {"_top": "max"})
    peaks = b.own(peaks.withColumn("peak", F.greatest("capital", "_top", F.max("equity").over(b.window().rowsBetween(Window.unboundedPreceding, 0)))))
    risk = peaks.groupBy(*keys).agg(F.max_by("equity", F.struct(*order)).alias("final_equity"), F.max(1 - F.col("equity") / F.col("peak")).alias("max_drawdown"), (F.min("equity") <= 0).alias("bankrupt"))
    pnl = F.col("pnl")
    held = (micros(F.col("exit_ts")) - micros(F.col("entry_ts"))) / 1e6
    deals = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.greatest(pnl, F.lit(0.0))).alias("_gains"), F.sum(-F.least(pnl, F.lit(0.0))).alias("_losses"), F.avg(pnl).alias("expectancy"),
        F.avg((pnl > 0).cast("double")).alias("hit_rate"), F.sum(F.col("quantity") * (F.col("entry_price") + F.col("exit_price"))).alias("_traded"), F.sum(held).alias("_held"))
    j = bounds.select(*keys, "start", "end", "capital")
    for part in (moments, risk, deals):
        j = blocks.null_safe_join(j, part, keys, "left")
    j = j.fillna(0, ["trades"]).fillna(0.0, ["sharpe", "max_drawdown", "expectancy", "hit_rate", "_gains", "_losses", "_traded", "_held"]).fillna(False, ["bankrupt"])
    final = F.coalesce("final_equity", "capital")
    return j.select(
        *keys, final.alias("final_equity"), (final / F.col("capital") - 1).alias("net_return"), "sharpe", F.greatest(F.lit(0.0), "max_drawdown").alias("max_drawdown"), "bankrupt", "trades",
        F.when(F.col("_losses") > 0, ratio(F.col("_gains"), F.col("_losses"))).alias("profit_factor"), ((F.col("_gains") > 0) & (F.col("_losses") == 0)).alias("no_losing_trades"),
        "expectancy", "hit_rate", (F.col("_held") / ((micros(F.col("end")) - micros(F.col("start"))) / 1e6)).alias("exposure"), (F.col("_traded") / F.col("capital")).alias("turnover"))
