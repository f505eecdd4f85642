"""Statistical evidence over return series and run metrics, for many groups at once.

Series carry keys, ``rn`` (gapless position from 0) and ``ret``. Nothing here gathers a
series in one place: long-range sums go through prefix sums, paths of a bootstrap are
spread over tasks by path.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import normal
from ..functions.sampling import draw
from ..session import stage
from . import blocks, curves
from .metrics import compound
from .quality import fingerprint

TINY = 1e-12


def _sized(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.stddev_pop("ret").alias("sd0"), F.min("ret").alias("least"),
    )


# ---- regression ---------------------------------------------------------------------------

def hac_regression(series: DataFrame, keys: list[str], z_min: float = 1.645, minimum: int = 60) -> DataFrame:
    """Alpha and beta of ``ret`` on ``market`` with Newey-West errors, one row per group.

    Passes when the one-sided lower bound of alpha is positive. A degenerate group (too
    few rows, constant series) gets NULL estimates and does not pass.
    """
    x, y = F.col("market"), F.col("ret")
    m = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.covar_pop(x, y).alias("cxy"), F.stddev_pop(y).alias("dy"), F.stddev_pop(x).alias("dx"), F.var_pop(x).alias("vx"), F.avg(y).alias("my"),
    )
    n = F.col("n")
    det = n * n * F.col("vx")  # n * sum(x^2) - sum(x)^2 without its cancellation
    usable = (n >= minimum) & (F.col("dy") >= TINY) & (F.col("dx") >= TINY)
    m = m.withColumn("det", F.when(usable, det))
    m = m.withColumn("beta", F.when(F.col("det") != 0, F.col("cxy") / F.col("vx")))
    m = m.withColumn("alpha", (F.col("sy") - F.col("beta") * F.col("sx")) / n)
    m = m.withColumn("lags", F.least(n - 1, F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9))))).cast("int"))
    longest = m.agg(F.max("lags")).first()[0] or 1
    e = series.join(m.select(*keys, "alpha", "beta", "lags", "my"), keys)
    e = e.withColumn("e", y - F.col("alpha") - F.col("beta") * x).withColumn("ex", F.col("e") * x)
    b = blocks.split(e, keys, ["rn"], longest, position="rn")
    frame = b.window().rowsBetween(-longest, -1)

    def weighted(c: str) -> Column:
        past = F.collect_list(c).over(frame)
        k = lambda i: F.size(past) - i
        terms = F.transform(past, lambda v, i: F.when(k(i) <= F.col("lags"), v * (1 - k(i) / (F.col("lags") + 1))).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    rows = b.own(b.df.withColumn("pe", weighted("e")).withColumn("pex", weighted("ex")))
    meat = rows.groupBy(*keys).agg(
        F.sum(F.col("e") * F.col("e") + 2 * F.col("e") * F.col("pe")).alias("m11"),
        F.sum(F.col("e") * F.col("ex") + F.col("e") * F.col("pex") + F.col("ex") * F.col("pe")).alias("m12"),
        F.sum(F.col("ex") * F.col("ex") + 2 * F.col("ex") * F.col("pex")).alias("m22"),
        F.sum(F.col("e") * F.col("e")).alias("sse"), F.sum((y - F.col("my")) * (y - F.col("my"))).alias("sst"),
    )
    # First row of the inverse of X'X is (sxx, -sx) / det.
    j = m.join(meat, keys)
    a, c = F.col("sxx") / F.col("det"), -F.col("sx") / F.col("det")
    var = (a * a * F.col("m11") + 2 * a * c * F.col("m12") + c * c * F.col("m22")) * n / (n - 2)
    j = j.withColumn("alpha_se", F.sqrt(F.greatest(var, F.lit(0.0))))
    j = j.withColumn("alpha_se", F.when(F.col("alpha_se") >= TINY, F.col("alpha_se")))
    low = F.col("alpha") - z_min * F.col("alpha_se")
    return j.select(
        *keys, F.col("n").alias("observations"), "alpha", "beta", "alpha_se", (F.col("alpha") / F.col("alpha_se")).alias("alpha_z"),
        low.alias("alpha_lower"), (1 - F.col("sse") / F.nullif("sst", F.lit(0.0))).alias("r_squared"), F.col("lags").alias("hac_lags"),
        F.coalesce(low > 0, F.lit(False)).alias("passed"),
    )


# ---- bootstrap ----------------------------------------------------------------------------

def _paths(groups: DataFrame, keys: list[str], samples: int, block: Column, seed: int, more: list[str] = ()) -> DataFrame:
    """Every block draw of every path: path, k-th block, its circular start and length."""
    g = groups.withColumn("block", block.cast("long"))
    need = F.ceil(F.col("n") / F.col("block"))
    g = g.select(*keys, *more, "n", "block", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("path"), need.alias("_need"))
    # Few rows become very many here: a fixed number of tasks, which is not merged for being
    # small, shares out the paths before their draws are made.
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = g.repartition(tasks, *keys, "path").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_need") - 1)).alias("k")).drop("_need")
    start = draw(seed, F.col("path"), F.col("k"), F.col("block")) % F.col("n")
    size = F.least(F.col("block"), F.col("n") - F.col("k") * F.col("block"))
    return g.withColumn("start", start).withColumn("len", size)


def block_bootstrap(series: DataFrame, keys: list[str], samples: int = 1000, seed: int = 42, block_sizes: tuple[int, ...] = (5, 10, 20),
                    profit_min: float = 0.9, drawdown_max: float = 0.25, minimum: int = 60) -> DataFrame:
    """Circular block bootstrap of compounded returns, one row per group and block size.

    A block of returns acts on a curve through four numbers (:mod:`curves`). These are computed once per start; a path is then a tree of
    merges of its blocks, so no path or series is held as an array and a long path is spread over many tasks.
    """
    g = _sized(series, keys)
    ok = (F.col("n") >= minimum) & (F.col("sd0") >= TINY) & (F.col("least") > -1)
    widest = max(block_sizes)
    # The circle: the first rows again after the last.
    sized = series.select(*keys, "rn", "ret").join(g.filter(ok).select(*keys, "n"), keys)
    head = sized.filter(F.col("rn") < widest).withColumn("rn", F.col("rn") + F.col("n"))
    ring = sized.unionByName(head).withColumn("_neg", -F.col("rn"))
    b = blocks.split_dense(ring, keys, ["_neg"], F.col("_neg"), widest)
    ahead = F.array(*[F.coalesce(F.lag("ret", j).over(b.window()), F.lit(0.0)) if j else F.col("ret") for j in range(widest)])
    starts = b.own(b.df.withColumn("ahead", ahead)).filter(F.col("rn") < F.col("n")).select(*keys, "n", F.col("rn").alias("start"), "ahead")

    sizes = F.explode(F.array(*[F.lit(s).cast("long") for s in block_sizes]))
    fold = lambda n: F.aggregate(F.slice("ahead", F.lit(1), n.cast("int")), curves.empty(), curves.step)
    # Once per start and block size, whole and cut to what the last block of a path may use.
    rest = F.col("n") - (F.ceil(F.col("n") / F.col("block")) - 1) * F.col("block")
    starts = starts.withColumn("block", sizes).select(*keys, "block", "start", fold(F.col("block")).alias("whole"), fold(rest).alias("part"))
    draws = _paths(g.filter(ok).withColumn("_b", sizes), keys, samples, F.col("_b"), seed)
    hit = draws.join(starts, [*keys, "block", "start"])
    hit = hit.withColumn("s", F.when(F.col("len") == F.col("block"), F.col("whole")).otherwise(F.col("part")))
    per_path = [*keys, "block", "path"]
    merged = curves.merged(hit.select(*per_path, "k", "s"), per_path, "k", "s", longest=(g.agg(F.max("n")).first()[0] or 0) // min(block_sizes))
    path = merged.select(*per_path, (F.col("s.p") - 1).alias("profit"), F.col("s.dd").alias("drawdown"), F.col("s.lo").alias("lowest"))
    out = path.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("paths"),
        F.avg((F.col("profit") > 0).cast("double")).alias("profit_probability"),
        F.percentile("profit", F.lit(0.05)).alias("return_p05"),
        F.percentile("profit", F.lit(0.5)).alias("return_p50"),
        F.percentile("drawdown", F.lit(0.95)).alias("drawdown_p95"),
        F.avg((F.col("lowest") <= 0.05).cast("double")).alias("ruin_probability"),
    )
    passed = (F.col("profit_probability") >= profit_min) & (F.col("drawdown_p95") <= drawdown_max) & (F.col("ruin_probability") <= 0.01)
    return out.withColumn("passed", passed)


def _path_sums(series: DataFrame, keys: list[str], groups: DataFrame, samples: int, seed: int) -> DataFrame:
    """Sum and sum of squares of each resampled path, through prefix sums of the series."""
    b = blocks.split(series.select(*keys, "rn", "ret").withColumn("sq", F.col("ret") * F.col("ret")), keys, ["rn"], position="rn")
    rows = blocks.carried(b, {"_a": F.sum("ret"), "_q": F.sum("sq")}, {"_a": "sum", "_q": "sum"})
    run = b.window().rowsBetween(Window.unboundedPreceding, 0)
    prefix = b.own(rows.withColumn("p1", F.coalesce("_a", F.lit(0.0)) + F.sum("ret").over(run))
                   .withColumn("p2", F.coalesce("_q", F.lit(0.0)) + F.sum("sq").over(run))).select(*keys, F.col("rn").alias("pos"), "p1", "p2")
    block = F.greatest(F.lit(2), F.bround(F.pow(F.col("n").cast("double"), F.lit(1 / 3))))
    d = _paths(groups, keys, samples, block, seed)
    stop = F.col("start") + F.col("len") - 1
    # A block is a difference of two prefix sums, plus the whole sum when it wraps.
    looks = F.array(
        F.struct((stop % F.col("n")).alias("pos"), F.lit(1.0).alias("sign")),
        F.struct((F.col("start") - 1).alias("pos"), F.lit(-1.0).alias("sign")),
        F.struct((F.col("n") - 1).alias("pos"), F.when(stop >= F.col("n"), 1.0).otherwise(0.0).alias("sign")),
    )
    looked = d.select(*keys, "path", "n", F.explode(looks).alias("l")).select(*keys, "path", "n", "l.*").filter("pos >= 0 AND sign <> 0")
    # Many draws look at the same position, most of all at the last: count them first.
    looked = looked.groupBy(*keys, "path", "pos").agg(F.sum("sign").alias("sign"), F.max("n").alias("n"))
    return looked.join(prefix, [*keys, "pos"]).groupBy(*keys, "path").agg(
        F.max("n").alias("n"), F.sum(F.col("sign") * F.col("p1")).alias("s1"), F.sum(F.col("sign") * F.col("p2")).alias("s2"))


def mean_interval(series: DataFrame, keys: list[str], samples: int = 200, seed: int = 42, minimum: int = 60) -> DataFrame:
    """95 % block-bootstrap interval of the mean return."""
    g = _sized(series, keys)
    ok = (F.col("n") >= minimum) & (F.col("sd0") >= TINY)
    sums = _path_sums(series, keys, g.filter(ok), samples, seed).withColumn("m", F.col("s1") / F.col("n"))
    est = sums.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))
    status = F.when(F.col("lower").isNull(), F.lit("INSUFFICIENT_DATA")).otherwise(F.lit("ESTIMATED"))
    return g.select(*keys).join(est, keys, "left").withColumn("status", status)


def deflated_sharpe(series: DataFrame, keys: list[str], trials: int, attempt: int = 1, samples: int = 200, seed: int = 42,
                    probability_min: float = 0.95, minimum: int = 30) -> DataFrame:
    """Sharpe ratio against the best expected of ``trials`` lucky tries.

    The spread of Sharpe ratios under no skill comes from a block bootstrap of the centred
    returns. ``trials`` is at least ``attempt``; the required z rises with each attempt.
    """
    trials = max(trials, attempt)
    unit = NormalDist()
    gamma = 0.5772156649015329
    luck = 0.0
    if trials > 1:
        luck = -(1 - gamma) * unit.inv_cdf(1 / trials) - gamma * unit.inv_cdf(1 / (trials * math.e))
    alpha = (1 - probability_min) / (attempt * (attempt + 1))
    z_min = -unit.inv_cdf(alpha)
    g = _sized(series, keys)
    ok = (F.col("n") >= minimum) & (F.col("sd") >= TINY)
    good = g.filter(ok)
    sums = _path_sums(series, keys, good, samples, seed).join(good.select(*keys, "mean"), keys)
    n = F.col("n")
    c1 = F.col("s1") - n * F.col("mean")
    c2 = F.col("s2") - 2 * F.col("mean") * F.col("s1") + n * F.col("mean") * F.col("mean")
    sd = F.sqrt(F.greatest((c2 - c1 * c1 / n) / (n - 1), F.lit(0.0)))
    null = sums.withColumn("sr", c1 / n / F.greatest(sd, F.lit(TINY))).groupBy(*keys).agg(F.stddev_samp("sr").alias("dispersion"))
    std = (F.col("ret") - F.col("mean")) / F.col("sd")
    shape = series.join(good.select(*keys, "mean", "sd"), keys).groupBy(*keys).agg(
        F.avg(F.pow(std, F.lit(3))).alias("skew"), F.avg(F.pow(std, F.lit(4))).alias("kurtosis"))
    j = good.join(null, keys).join(shape, keys)
    sr = F.col("mean") / F.col("sd")
    bench = F.col("dispersion") * luck
    eff = F.least(n.cast("double"), 1 + 1 / F.greatest(F.col("dispersion") * F.col("dispersion"), F.lit(TINY)))
    denom = F.sqrt(F.greatest(F.lit(TINY), 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr))
    z = (sr - bench) * F.sqrt(eff - 1) / denom
    est = j.select(*keys, bench.alias("sr_benchmark"), eff.alias("effective_observations"), z.alias("dsr_z"))
    out = g.select(*keys).join(est, keys, "left").fillna(0.0, ["dsr_z"])
    return out.withColumns({
        "dsr": F.when(F.col("sr_benchmark").isNull(), F.lit(0.0)).otherwise(normal.cdf(F.col("dsr_z"))),
        "sequential_passed": F.col("sr_benchmark").isNotNull() & (F.col("dsr_z") >= z_min),
        "sequential_z_min": F.lit(z_min),
    })


def concentration(series: DataFrame, keys: list[str], best: int = 5, minimum: int = 60) -> DataFrame:
    """Compounded return once the best positive days are set to zero."""
    logs = series.select(*keys, "rn", "ret", F.floor(F.col("rn") / blocks.BLOCK_ROWS).alias("_block"), F.when(F.col("ret") > -1, F.ln(1 + F.col("ret"))).alias("lg"))
    whole = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ret").alias("least"), F.sum("lg").alias("total"))
    top = logs.filter(F.col("ret") > 0)
    # Best of each block first, then best of those: the last step sees few rows.
    for part in ([*keys, "_block"], keys):
        w = Window.partitionBy(*part).orderBy(F.desc("ret"), F.desc("rn"))
        top = top.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= best)
    cut = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("removed_days"), F.sum("lg").alias("_cut"))
    j = whole.join(cut, keys, "left").fillna(0, ["removed_days"]).fillna(0.0, ["_cut"])
    ok = (F.col("n") >= minimum) & (F.col("least") > -1)
    net = F.when(ok, F.exp(F.col("total") - F.col("_cut")) - 1)
    return j.select(*keys, F.when(ok, F.col("removed_days")).otherwise(F.lit(0)).alias("removed_days"), net.alias("net_without_best"),
                    F.coalesce(net > 0, F.lit(False)).alias("passed"))


# ---- verdicts over run metrics ------------------------------------------------------------

def viable(min_trades: int = 30, drawdown_max: float = 0.25) -> Column:
    dd = F.greatest("max_drawdown", "intrabar_drawdown")
    return (~F.col("bankrupt")) & (F.col("net_return") > 0) & (F.col("sharpe") > 0) & (dd <= drawdown_max) & (F.col("trades") >= min_trades)


def fold_bounds(sizes: DataFrame, split: Column, folds: int, gap: int) -> DataFrame:
    """Train and test row ranges of expanding walk-forward folds, from (keys, n)."""
    f = sizes.withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("_split", split.cast("long"))
    edge = lambda i: F.floor(F.col("_split") + (F.col("n") - F.col("_split")) * i / folds)
    f = f.withColumn("_a", edge(F.col("_f") - 1)).withColumn("_b", edge(F.col("_f")))
    return f.withColumn("gap_end", F.col("_a") - gap).select(
        *[c for c in sizes.columns if c != "n"], F.col("_f").alias("fold"), F.col("_a").alias("test_from"), F.col("_b").alias("test_to"), F.col("gap_end").alias("train_to"))


def walk_forward(metrics: DataFrame, test_returns: DataFrame, keys: list[str], folds: int, min_trades: int = 30,
                 drawdown_max: float = 0.25) -> DataFrame:
    """Verdict from fold metrics (keys, fold, part = train or test, ...) and test returns.

    ``test_returns``: keys, ``rn``, ``ret`` of all test folds in time order.
    """
    need = math.ceil(2 * folds / 3)
    least = max(1, math.ceil(min_trades / folds))
    m = metrics.withColumn("_ok", F.when(F.col("part") == "train", viable(min_trades, drawdown_max)).otherwise(viable(least, drawdown_max)))
    per_fold = m.groupBy(*keys, "fold").agg(
        F.min("_ok").alias("passed"),
        F.max(F.when(F.col("part") == "test", F.col("trades"))).alias("trades"),
        F.max(F.when(F.col("part") == "test", F.col("bankrupt") | (F.greatest("max_drawdown", "intrabar_drawdown") > drawdown_max))).alias("broken"),
    )
    tally = per_fold.groupBy(*keys).agg(F.sum(F.col("passed").cast("int")).alias("passing_folds"), F.sum("trades").alias("trades"), F.max("broken").alias("_broken"))
    # The joined test curve: running growth through per-block sums.
    lg = test_returns.withColumn("lg", F.ln(F.greatest(1 + F.col("ret"), F.lit(TINY))))
    b = blocks.split(lg, keys, ["rn"], position="rn")
    rows = blocks.carried(b, {"_g": F.sum("lg")}, {"_g": "sum"})
    grown = b.own(rows.withColumn("equity", F.exp(F.coalesce("_g", F.lit(0.0)) + F.sum("lg").over(b.window().rowsBetween(Window.unboundedPreceding, 0)))))
    from .metrics import running_peak

    peaked = running_peak(grown.drop("_g").withColumn("one", F.lit(1.0)).withColumn("ts", F.col("rn")), keys, initial="one", position="rn")
    curve = peaked.groupBy(*keys).agg((F.max_by("equity", "rn") - 1).alias("net_return"), F.greatest(F.lit(0.0), F.max(1 - F.col("equity") / F.col("peak"))).alias("max_drawdown"))
    j = tally.join(curve, keys)
    passed = (F.col("passing_folds") >= need) & (F.col("net_return") > 0) & (F.col("max_drawdown") <= drawdown_max) & (F.col("trades") >= min_trades) & ~F.col("_broken")
    return j.withColumn("passed", passed).drop("_broken")


def benchmark_compare(strategy: DataFrame, passive: DataFrame, keys: list[str]) -> DataFrame:
    names = ["net_return", "sharpe", "max_drawdown", "trades"]
    j = strategy.select(*keys, *names).join(passive.select(*keys, *[F.col(n).alias(f"passive_{n}") for n in names]), keys)
    better = (F.col("net_return") > F.col("passive_net_return")) | (F.col("max_drawdown") < F.col("passive_max_drawdown"))
    passed = (F.col("net_return") > 0) & (F.col("trades") > 0) & (F.col("sharpe") > F.col("passive_sharpe")) & better
    status = F.when(F.col("passive_trades") == 0, F.lit("INSUFFICIENT_DATA")).when(passed, F.lit("PASSED")).otherwise(F.lit("FAILED"))
    return j.withColumn("status", status).withColumn("passed", F.col("status") == "PASSED")


def stress_verdict(metrics: DataFrame, keys: list[str], pass_min: float = 0.8, min_trades: int = 30, drawdown_max: float = 0.25) -> DataFrame:
    """Share of viable variants among singles and joints (metrics has ``joint`` and ``parameter``)."""
    ok = viable(min_trades, drawdown_max).cast("double")
    a = metrics.groupBy(*keys).agg(
        F.count(F.when(~F.col("joint"), 1)).alias("singles"), F.avg(F.when(~F.col("joint"), ok)).alias("single_fraction"),
        F.count(F.when(F.col("joint"), 1)).alias("joints"), F.avg(F.when(F.col("joint"), ok)).alias("joint_fraction"),
        F.countDistinct(F.when(~F.col("joint"), F.col("parameter"))).alias("parameters"),
    )
    passed = (F.col("single_fraction") >= pass_min) & (F.col("singles") >= 4) & (F.col("joint_fraction") >= pass_min)
    return a.withColumn("passed", F.coalesce(passed, F.lit(False)))


def degradation(is_sharpe: Column, oos_sharpe: Column) -> Column:
    return F.when(is_sharpe > 0, F.greatest(F.lit(0.0), 1 - oos_sharpe / F.nullif(is_sharpe, F.lit(0.0)))).otherwise(F.lit(1.0))


def gate_reasons(probability_min: float = 0.95, z_min: float = 1.2, min_trades: int = 30, drawdown_max: float = 0.25, folds: int = 3) -> Column:
    """Rejection reasons of a candidate whose results sit in is_*, oos_* and other columns."""
    c = F.col
    out_of_limits = lambda p: (F.greatest(f"{p}_max_drawdown", f"{p}_intrabar_drawdown") > drawdown_max) | (c(f"{p}_net_return") <= 0)
    checks = {
        "deflated_sharpe": (c("dsr") < probability_min) | (c("dsr_z") <= z_min),
        "sequential_evidence": ~c("sequential_passed"),
        "sharpe_or_degradation": (c("is_sharpe") <= 0) | (c("oos_sharpe") <= 0) | (degradation(c("is_sharpe"), c("oos_sharpe")) > 0.2),
        "too_few_trades": (c("is_trades") < min_trades) | (c("oos_trades") < min_trades),
        "return_or_drawdown": out_of_limits("is") | out_of_limits("oos"),
        "profit_factor": ~(c("oos_no_losing_trades") | (F.coalesce("oos_profit_factor", F.lit(0.0)) >= 1.2)),
        "forward_windows": c("positive_windows") < math.ceil(2 * folds / 3),
        "benchmark": ~c("benchmark_passed"),
        "execution_delay": c("execution_delay_bars") > 0,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in checks.items()]))


# ---- diagnostics --------------------------------------------------------------------------

def ahead(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Add later values: name -> (column, rows ahead). Needs ``rn``."""
    most = max(k for _, k in columns.values())
    flipped = df.withColumn("_neg", -F.col("rn"))
    b = blocks.split_dense(flipped, keys, ["_neg"], F.col("_neg"), most)
    return b.own(b.df.withColumns({n: F.lag(c, k).over(b.window()) for n, (c, k) in columns.items()})).drop("_neg")


def forward_means(rows: DataFrame, keys: list[str], horizons: tuple[int, ...] = (1, 5, 20), direction: int = 1) -> DataFrame:
    """Mean gross return from the next open over each horizon, after a signal and always."""
    r = ahead(rows, keys, {"_o0": ("open", 1), **{f"_o{h}": ("open", 1 + h) for h in horizons}})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (direction * (F.col(f"_o{h}") / F.col("_o0") - 1)).alias("fwd")) for h in horizons]))
    long = r.select(*keys, "entry", each.alias("e")).select(*keys, "entry", "e.*").filter(F.col("fwd").isNotNull())
    hit = F.when(F.col("entry"), F.col("fwd"))
    return long.groupBy(*keys, "horizon").agg(F.count(hit).alias("events"), F.avg(hit).alias("conditional_mean"), F.avg("fwd").alias("unconditional_mean"))


def forward_pairs(rows: DataFrame, keys: list[str], features: list[str], horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Long table of (feature, horizon, value, fwd): fwd from next open to a later close."""
    r = ahead(rows, keys, {"_o": ("open", 1), **{f"_c{h}": ("close", h) for h in horizons}})
    hs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"_c{h}") / F.col("_o") - 1).alias("fwd")) for h in horizons]))
    fs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    return r.select(*keys, "ts", hs.alias("h"), *features).select(*keys, "ts", "h.*", fs.alias("f")).select(*keys, "ts", "horizon", "fwd", "f.*")


def feature_associations(pairs: DataFrame, keys: list[str], minimum: int = 60) -> DataFrame:
    """Correlation of each feature with the forward return and means in its outer quartiles."""
    from .quantiles import exact_quantiles

    p = stage(pairs.filter(F.col("value").isNotNull() & F.col("fwd").isNotNull()))
    by = [*keys, "feature", "horizon"]
    q = exact_quantiles(p, by, "value", {"q1": 0.25, "q3": 0.75})
    base = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.covar_samp("value", "fwd").alias("_c"), F.stddev_samp("value").alias("_sv"),
        F.stddev_samp("fwd").alias("_sf"))
    base = base.filter((F.col("observations") >= minimum) & (F.col("_sv") > 0) & (F.col("_sf") > 0))
    edge = p.join(q, by).groupBy(*by).agg(
        F.avg(F.when(F.col("value") <= F.col("q1"), F.col("fwd"))).alias("low_quartile_return"),
        F.avg(F.when(F.col("value") >= F.col("q3"), F.col("fwd"))).alias("high_quartile_return"))
    return base.join(edge, by).select(*by, "observations", (F.col("_c") / (F.col("_sv") * F.col("_sf"))).alias("correlation"),
                                      "low_quartile_return", "high_quartile_return").orderBy(F.desc(F.abs("correlation")))


def regime_breakdown(rows: DataFrame, keys: list[str], volatility: str, trend: str, training: Column) -> DataFrame:
    """Mean and compounded return under overlapping volatility and trend labels.

    The volatility threshold is the median of the training rows.
    """
    from .quantiles import exact_quantiles

    cut = exact_quantiles(rows.filter(training), keys, volatility, {"threshold": 0.5})
    j = rows.filter(~training).join(cut, keys)
    labels = F.array_compact(F.array(
        F.when(F.col(volatility) > F.col("threshold"), F.lit("high_volatility")), F.when(F.col(volatility) <= F.col("threshold"), F.lit("low_volatility")),
        F.when(F.col(trend) > 0, F.lit("uptrend")), F.when(F.col(trend) < 0, F.lit("downtrend"))))
    return j.select(*keys, "ret", F.explode(labels).alias("regime")).groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.avg("ret").alias("mean_return"), compound(F.col("ret")).alias("compounded_return"))


def shifted_signals(rows: DataFrame, keys: list[str], start: str, samples: int = 20, seed: int = 42) -> DataFrame:
    """Placebo schedules: entry and exit rolled around inside the test rows.

    ``start`` names the first test row of each group. Earlier rows get no signal.
    """
    n = rows.filter(F.col("rn") >= F.col(start)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = rows.join(n.filter("_n >= 30"), keys).withColumn("placebo", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    shift = 1 + draw(seed, F.col("placebo")) % (F.col("_n") - 1)
    each = each.withColumn("_to", F.when(F.col("rn") >= F.col(start), F.col(start) + F.pmod(F.col("rn") - F.col(start) + shift, F.col("_n"))))
    moved = each.filter("_to IS NOT NULL").select(*keys, "placebo", F.col("_to").alias("rn"), F.col("entry").alias("_e"), F.col("exit").alias("_x"))
    return each.drop("entry", "exit", "_to", "_n").join(moved, [*keys, "placebo", "rn"], "left").withColumn("entry", F.coalesce("_e", F.lit(False))).withColumn(
        "exit", F.coalesce("_x", F.lit(False))).drop("_e", "_x")


def causality_audit(df: DataFrame, evaluate, keys: list[str], order: list[str], numeric: list[str], outputs: list[str],
                    cuts: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """Do answers up to a cut stay the same without, and with a distorted, future?

    ``evaluate`` maps rows to rows with ``outputs``. Needs ``rn``; one row per cut with the
    rows compared and the answers that changed.
    """
    n = df.groupBy(*keys).agg((F.max("rn") + 1).alias("_n"))
    same = [*keys, *order]
    full = evaluate(df).select(*same, *[F.col(o).alias(f"_full_{o}") for o in outputs])
    parts = []
    for cut in cuts:
        at = df.join(n, keys).withColumn("_past", F.col("rn") < F.floor(F.col("_n") * cut))
        prefix = evaluate(at.filter("_past").drop("_past", "_n")).select(*same, *outputs)
        bent = at.withColumns({c: F.when(F.col("_past"), F.col(c)).otherwise(F.col(c) * 1.731) for c in numeric})
        changed = evaluate(bent.drop("_n")).filter("_past").select(*same, *[F.col(o).alias(f"_bent_{o}") for o in outputs])
        differs = F.lit(False)
        for o in outputs:
            differs = differs | ~F.col(o).eqNullSafe(F.col(f"_full_{o}")) | ~F.col(o).eqNullSafe(F.col(f"_bent_{o}"))
        j = prefix.join(full, same, "left").join(changed, same, "left")
        parts.append(j.agg(F.lit(cut).alias("cut"), F.count(F.lit(1)).alias("compared"), F.sum(differs.cast("int")).alias("changed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("changed") == 0)


def confirmation_end(bars: DataFrame, keys: list[str], base: int, target: int, min_days: int, need: int = 120, slot_bars: int = 4096) -> DataFrame:
    """First bar that has ``need`` complete signal bars and the minimum days behind it.

    Complete signal bars are counted per slot of ``slot_bars`` calendar places; only the slot that holds the wanted one is numbered.
    """
    from ..functions.guards import add_seconds, floor_ts, micros

    bucket = floor_ts(F.col("ts"), target)
    g = bars.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    whole = g.filter((F.col("_n") == target // base) & (F.col("_last") == add_seconds(F.col("_b"), target - base)))
    whole = whole.withColumn("_slot", blocks.time_slot(micros(F.col("_b")), target * slot_bars))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = whole.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", before)
    slots = slots.filter((F.col("_before") < need) & (F.col("_before") + F.col("_m") >= need)).drop("_m")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy("_b"))
    nth = whole.join(slots, [*keys, "_slot"]).withColumn("_k", place).filter(F.col("_k") == need).select(*keys, F.col("_last").alias("_nth"))
    span = bars.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_final"))
    horizon = F.col("_first") + F.make_dt_interval(F.lit(min_days))
    due = span.join(nth, keys, "left").withColumn("_due", F.when(F.col("_final") >= horizon, F.greatest("_nth", horizon)))
    due = due.withColumn("_due", F.when(F.col("_nth").isNotNull(), F.col("_due")))
    at = bars.join(due.select(*keys, "_due"), keys).filter(F.col("ts") >= F.col("_due")).groupBy(*keys).agg(F.min("ts").alias("end_ts"))
    return span.select(*keys).join(at, keys, "left")


def forward_append(frozen: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Frozen history as it was, plus incoming rows later than its last; first one wins."""
    last = frozen.groupBy(*keys).agg(F.max(order).alias("_last"))
    new = incoming.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")
    both = frozen.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = F.struct("_p", *[c for c in frozen.columns if c not in (*keys, order)])
    kept = both.groupBy(*keys, order).agg(F.min(rest).alias("_r"))
    return kept.select(*keys, order, "_r.*").select(*frozen.columns, (F.col("_p") == 1).alias("appended"))


def variant_screen(metrics: DataFrame, min_trades: int = 30) -> DataFrame:
    """Does a variant's median training Sharpe over assets beat the original rule's?

    ``metrics`` has variant (``original`` for the baseline), asset, sharpe, trades.
    """
    score = F.when(F.col("trades") >= min_trades, F.col("sharpe")).otherwise(F.lit(-1000.0))
    m = metrics.groupBy("variant").agg(F.percentile(score, F.lit(0.5)).alias("score"))
    base = m.filter(F.col("variant") == "original").select(F.col("score").alias("original_score"))
    return m.filter(F.col("variant") != "original").crossJoin(F.broadcast(base)).withColumn("passed", F.col("score") > F.col("original_score"))


def signal_fingerprint(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Hash of the signal series: every row's position and flags, hashed and summed, so nothing is gathered."""
    code = F.concat_ws("", *[F.when(F.col(f), F.lit("1")).otherwise(F.lit("0")) for f in flags])
    return fingerprint(rows, keys, F.concat_ws(":", F.col("rn").cast("string"), code)).select(*keys, F.col("sha256").alias("fingerprint"))
