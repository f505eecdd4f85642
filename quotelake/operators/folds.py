"""Walk-forward evidence in time, from a table of returns and a table of trades.

Folds are stretches of calendar time: expanding training, a purged gap as long as a position may be held, disjoint tests. Nothing is run
again: the returns and trades are given, and a trade counts in a stretch only if it begins and ends in it, so one that reaches over an edge
is in neither side. Training stretches overlap, yet each return is read once: the edges of all folds cut time into
elementary pieces, a piece is summarised once, and a stretch is the merge of its pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import add_seconds, floor_ts, micros
from ..session import stage
from . import blocks, curves

#: Fewest grid intervals of a training and a test stretch.
TRAIN_MIN, TEST_MIN = 60, 30
TINY = 1e-12


def time_folds(bounds: DataFrame, keys: list[str], folds: int, grid: int, holding_seconds: int | None = None, decisions: DataFrame | None = None, holding_events: int = 0) -> DataFrame:
    """keys, fold, train_from, train_to, test_from, test_to, enough; from (keys, start, split, end).

    Tests cut [split, end) into ``folds`` stretches of whole grid intervals, as equal as can be. Training ends a holding time before its test, on
    the grid: ``holding_seconds`` earlier, or, given ``decisions`` (keys, ts), at the ``holding_events``-th decision before the test. ``enough`` says that
    training has 60 intervals and the test 30; with fewer decisions than a holding takes there is no training and it is false.
    """
    periods = F.floor((micros(F.col("end")) - micros(F.col("split"))) / (grid * 1_000_000))
    f = bounds.select(*keys, "start", "split", periods.alias("_n"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    at = lambda i: F.floor(F.col("_n") * i / folds).cast("long")
    f = f.withColumn("_a", at(F.col("fold") - 1)).withColumn("_b", at(F.col("fold")))
    when = lambda c: F.timestamp_micros(micros(F.col("split")) + F.col(c) * F.lit(grid * 1_000_000))
    f = f.withColumn("test_from", when("_a")).withColumn("test_to", when("_b"))
    if decisions is None:
        f = f.withColumn("train_to", floor_ts(add_seconds(F.col("test_from"), -int(holding_seconds or 0)), grid))
    else:
        # the k-th decision before an edge: numbered once, looked up by number
        d = stage(blocks.with_row_number(decisions.select(*keys, "ts").filter(F.col("ts").isNotNull()), keys, ["ts"]))
        before = _count_before(f.select(*keys, "fold", "test_from"), d, keys)
        f = f.join(before, [*keys, "fold"]).withColumn("rn", F.col("_before") - holding_events)
        f = f.join(d.select(*keys, "rn", F.col("ts").alias("_held")), [*keys, "rn"], "left").withColumn("train_to", floor_ts(F.col("_held"), grid))
    long_enough = (micros(F.col("train_to")) - micros(F.col("start")) >= TRAIN_MIN * grid * 1_000_000) & (F.col("_b") - F.col("_a") >= TEST_MIN)
    return f.select(*keys, "fold", F.col("start").alias("train_from"), "train_to", "test_from", "test_to", F.coalesce(long_enough, F.lit(False)).alias("enough"))


def _count_before(edges: DataFrame, numbered: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of a numbered series lie before each edge: one more than the number of the last of them."""
    from .asof import asof

    last = asof(edges, numbered, keys, "test_from", "ts", ["rn"], strict=True, right_order="rn", prefix="_last_")
    return last.select(*keys, "fold", F.coalesce(F.col("_last_rn") + 1, F.lit(0)).alias("_before"))


def _stretches(folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fold, part, seg_from, seg_to."""
    part = lambda p: F.struct(F.lit(p).alias("part"), F.col(f"{p}_from").alias("seg_from"), F.col(f"{p}_to").alias("seg_to"))
    return folds.select(*keys, "fold", F.explode(F.array(part("train"), part("test"))).alias("s")).select(*keys, "fold", "s.*")


def _few(df: DataFrame) -> DataFrame:
    """Sent to every task while it is small; a written table."""
    return F.broadcast(df) if df.count() <= blocks.BROADCAST_SLOTS else df


def fold_metrics(returns: DataFrame, trades: DataFrame, folds: DataFrame, keys: list[str], grid: int, periods_per_year: float = 252.0) -> DataFrame:
    """keys, fold, part and the metrics of that stretch: periods, net_return, sharpe, max_drawdown, bankrupt, trades, expectancy, purged.

    ``returns``: keys, ``ts`` (the end of the interval a return belongs to, one a grid interval), ``ret``. ``trades``: keys, entry_ts, exit_ts, pnl. A return at t is in
    (from, to]; a trade is in [from, to] as a whole, and ``purged`` counts those that are open at its end. NULL returns and open trades without an exit
    are in no stretch; the latter are purged where they begin.
    """
    folds = stage(folds)
    parts = stage(_stretches(folds.filter("enough"), keys))
    edges = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("train_from", "train_to", "test_from", "test_to")))))
    cuts = _few(stage(folds.filter("enough").groupBy(*keys).agg(edges.alias("_edges"))))
    rows = returns.filter(F.col("ret").isNotNull()).join(cuts, keys).withColumn("piece", F.size(F.filter("_edges", lambda e: e < F.col("ts"))))
    rows = rows.filter((F.col("piece") > 0) & (F.col("piece") < F.size("_edges")))
    place = F.floor((micros(F.col("ts")) - micros(F.element_at("_edges", 1))) / (grid * 1_000_000)).cast("long")
    rows = stage(rows.select(*keys, "piece", place.alias("_at"), "ret", F.element_at("_edges", F.col("piece")).alias("_from"), F.element_at("_edges", F.col("piece") + 1).alias("_to")))
    per = [*keys, "piece"]
    moments = rows.groupBy(*per).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), (F.var_pop("ret") * F.count(F.lit(1))).alias("m2"), F.min("_from").alias("_from"), F.min("_to").alias("_to"))
    pieces = stage(moments.join(curves.summaries(rows, per, "_at", "ret"), per))
    j = parts.join(pieces, keys).filter((F.col("_from") >= F.col("seg_from")) & (F.col("_to") <= F.col("seg_to")))
    listed = F.array_sort(F.collect_list(F.struct("piece", "n", "mean", "m2", "curve")))
    got = j.groupBy(*keys, "fold", "part").agg(listed.alias("_l")).withColumn("_m", F.aggregate("_l", _moments(F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0)), _add))
    got = got.withColumn("_c", F.aggregate(F.transform("_l", lambda x: x["curve"]), curves.empty(), curves.merge))
    sd = F.sqrt(F.col("_m.m2") / F.nullif(F.col("_m.n") - 1, F.lit(0)))
    got = got.select(
        *keys, "fold", "part", F.col("_m.n").alias("periods"), (F.col("_c.p") - 1).alias("net_return"),
        F.when(sd > TINY, F.col("_m.mean") / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods_per_year)).otherwise(0.0).alias("sharpe"),
        F.col("_c.dd").alias("max_drawdown"), (F.col("_c.lo") <= 0).alias("bankrupt"), F.col("_c").alias("curve"))
    t = trades.join(_few(parts), keys)
    begins = (F.col("entry_ts") >= F.col("seg_from")) & (F.col("entry_ts") < F.col("seg_to"))
    whole = begins & (F.col("exit_ts") <= F.col("seg_to"))
    deals = t.filter(begins).groupBy(*keys, "fold", "part").agg(
        F.count(F.when(whole, 1)).alias("trades"), F.avg(F.when(whole, F.col("pnl"))).alias("expectancy"),
        F.count(F.when(F.coalesce(~whole, F.lit(True)), 1)).alias("purged"))
    return got.join(deals, [*keys, "fold", "part"], "left").fillna(0, ["trades", "purged"]).fillna(0.0, ["expectancy"])


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), mean.cast("double").alias("mean"), m2.cast("double").alias("m2"))


def _add(a: Column, b: Column) -> Column:
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    return _moments(n, a["mean"] + apart * b["n"] / n, a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n)


def walk_forward_in_time(returns: DataFrame, trades: DataFrame, folds: DataFrame, keys: list[str], grid: int, count: int, min_trades: int = 30, drawdown_max: float = 0.25, periods_per_year: float = 252.0) -> DataFrame:
    """One verdict per key: status (PASSED, FAILED, INSUFFICIENT_DATA), passing_folds, trades and purged (of the tests and all stretches), net_return and
    max_drawdown of the joined tests.

    A fold passes where training and test both gain, with a Sharpe ratio above zero, within the drawdown limit and not bankrupt, on ``min_trades`` and a fold's share
    of them. Two thirds of the folds must pass, the joined tests must gain within the limit, on ``min_trades`` trades, and no test may break it. A key with a fold that is too short has
    INSUFFICIENT_DATA and no figures.
    """
    folds = stage(folds)
    m = stage(fold_metrics(returns, trades, folds, keys, grid, periods_per_year))
    least = max(1, math.ceil(min_trades / count))
    need = F.when(F.col("part") == "train", min_trades).otherwise(least)
    ok = ~F.col("bankrupt") & (F.col("net_return") > 0) & (F.col("sharpe") > 0) & (F.col("max_drawdown") <= drawdown_max) & (F.col("trades") >= need)
    test = F.col("part") == "test"
    per_fold = m.groupBy(*keys, "fold").agg(F.min(ok).alias("_ok"), F.count(F.lit(1)).alias("_parts"), F.sum(F.when(test, F.col("trades"))).alias("trades"), F.sum("purged").alias("purged"),
                                            F.max(F.when(test, F.col("bankrupt") | (F.col("max_drawdown") > drawdown_max))).alias("_broken"))
    tally = per_fold.groupBy(*keys).agg(F.sum((F.col("_ok") & (F.col("_parts") == 2)).cast("int")).alias("passing_folds"), F.sum("trades").alias("trades"), F.sum("purged").alias("purged"), F.max("_broken").alias("_broken"))
    joined = m.filter(test).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fold", "curve"))).alias("_l"))
    joined = joined.withColumn("_c", F.aggregate(F.transform("_l", lambda x: x["curve"]), curves.empty(), curves.merge)).select(*keys, (F.col("_c.p") - 1).alias("net_return"), F.col("_c.dd").alias("max_drawdown"))
    enough = folds.groupBy(*keys).agg(F.min("enough").alias("_enough"))
    j = enough.join(tally, keys, "left").join(joined, keys, "left")
    passed = (F.col("passing_folds") >= math.ceil(2 * count / 3)) & (F.col("net_return") > 0) & (F.col("max_drawdown") <= drawdown_max) & (F.col("trades") >= min_trades) & ~F.col("_broken")
    status = F.when(~F.col("_enough"), "INSUFFICIENT_DATA").when(passed, "PASSED").otherwise("FAILED")
    shown = lambda c: F.when(F.col("_enough"), F.col(c)).alias(c)
    return j.select(*keys, status.alias("status"), *[shown(c) for c in ("passing_folds", "trades", "purged", "net_return", "max_drawdown")])
