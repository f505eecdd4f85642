"""Queries over trial registries, rule tables, audit logs and result inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sampling import draws
from ..functions.signals import FAMILIES, reads
from ..session import stage
from . import blocks

# Bounds of the one-at-a-time shocks.
BOUNDS = {
    "fast": (2, 40), "slow": (10, 150), "threshold": (0.1, 3), "allocation": (0.01, 0.95), "stop_loss": (0.005, 0.15),
    "take_profit": (0.01, 0.4), "max_holding": (2, 100),
}
WHOLE = ("fast", "slow", "max_holding")


def _fixed(c: Column) -> Column:
    """A number as text, in millionths."""
    return F.round(c * 1e6).cast("long").cast("string")


def _inactive(name: str) -> Column:
    idle = [f for f in FAMILIES if name in ("fast", "threshold") and name not in reads(f)]
    by_family = F.col("family").isin(*idle) if idle else F.lit(False)
    return by_family & (F.col("regime") != "low_volatility") if name == "fast" else by_family


#: Rules and tries of one task: its memory does not grow with the table.
TASK_ROWS = 1 << 18


def _spread(rules: DataFrame, key: str, per_rule: int = 1) -> DataFrame:
    """Rules of one key together, in as many parts as their number asks for; what is grouped by the key later is not shuffled again."""
    return rules.repartition(max(1, -(-rules.count() * per_rule // TASK_ROWS)), key)


def _options(rules: DataFrame) -> dict[str, Column]:
    """Per parameter, a rule's values moved by -20 % or +20 % inside its bounds, as an array of (factor, value) without repeats."""
    out = {}
    for name, (low, high) in BOUNDS.items():
        moved = []
        for factor in (0.8, 1.2):
            v = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col(name) * factor))
            v = (F.bround(v) if name in WHOLE else F.bround(v, 8)).cast("double")
            ok = ~_inactive(name) & (v != F.col(name))
            if name == "fast":
                ok = ok & (v < F.col("slow"))
            if name == "slow":
                ok = ok & (v > F.col("fast"))
            moved.append((factor, v, ok))
        (f, v, ok), (g, w, ok2) = moved
        again = F.coalesce(ok & (v == w), F.lit(False))
        struct = lambda x, c: F.struct(F.lit(x).alias("factor"), c.alias("value"))
        out[name] = F.array_compact(F.array(F.when(ok, struct(f, v)), F.when(ok2 & ~again, struct(g, w))))
    return out


def param_grid(rules: DataFrame, key: str) -> DataFrame:
    """Each rule with one parameter moved by -20 % or +20 %, inside its bounds.

    Unused parameters, unchanged values, repeats and fast >= slow are left out.
    """
    of = lambda n, o: F.transform(o, lambda x: F.struct(F.lit(n).alias("parameter"), x["factor"].alias("factor"), x["value"].alias("value")))
    named = [of(n, o) for n, o in _options(rules).items()]
    exploded = _spread(rules, key, 2 * len(BOUNDS)).select(key, F.explode(F.concat(*named)).alias("o")).select(key, "o.*")
    return exploded.groupBy(key, "parameter", "value").agg(F.min("factor").alias("factor"))


def joint_grid(rules: DataFrame, key: str, samples: int = 8, tries: int | None = None, seed: int = 42) -> DataFrame:
    """Fixed joint perturbations: at least two parameters moved at once, no repeats.

    Try t moves a parameter when its draw is odd and picks among its options by another
    draw; the first ``samples`` distinct valid tries are kept. Ten tries are made per sample.

    Tries are made in two turns, the second only for rules that the first leaves short. Drawn tries are shuffled once, by their rule.
    """
    tries = 10 * samples if tries is None else tries
    values = {n: F.transform(o, lambda x: x["value"]).alias(n) for n, o in _options(rules).items()}
    one = _spread(rules, key, 2 * samples).select(key, F.struct("fast", "slow").alias("_own"), *values.values())
    gathered = {n: F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in BOUNDS}
    opts = stage(one.groupBy(key).agg(F.collect_set("_own").alias("_own"), *gathered.values()))
    first = stage(_joint(opts, key, samples, min(tries, 2 * samples), seed))
    full = first.filter(F.col("k") == samples).select(key)
    if tries > 2 * samples:
        short = stage(opts.join(full, key, "left_anti"))
        first = first.join(full, key, "left_semi").unionByName(_joint(short, key, samples, tries, seed))
    return first.select(key, "changes", "try", "moved")


def _joint(opts: DataFrame, key: str, samples: int, tries: int, seed: int) -> DataFrame:
    """The first ``samples`` distinct valid ones of the tries from 0 on, numbered from 1 (k)."""
    made = draws([seed, seed + 1], list(range(1, len(BOUNDS) + 1)))
    t = opts.filter(F.col(key).isNotNull()).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    t = t.withColumn("_r", made(F.col(key).cast("long"), F.col("try").cast("long")))
    picked = [
        F.when((F.size(n) > 0) & (F.col("_r")[i] % 2 == 1), F.get(n, (F.col("_r")[len(BOUNDS) + i] % F.greatest(F.size(n), F.lit(1))).cast("int"))).alias(f"_v{i}")
        for i, n in enumerate(BOUNDS)]
    t = t.select(key, "try", "_own", *picked)
    at = {n: F.col(f"_v{i}") for i, n in enumerate(BOUNDS)}
    moved = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in at.values()), F.lit(0)).cast("long")
    apart = F.exists("_own", lambda r: F.coalesce(at["fast"], r["fast"]) < F.coalesce(at["slow"], r["slow"]))
    t = t.withColumn("moved", moved).filter((F.col("moved") >= 2) & apart).drop("_own").repartition(max(1, -(-opts.count() * tries // TASK_ROWS)), key)
    per = t.groupBy(key, F.array(*[F.round(c * 1e6).cast("long") for c in at.values()]).alias("_m")).agg(F.min("try").alias("try"), F.min("moved").alias("moved"))
    w = Window.partitionBy(key).orderBy("try")
    per = per.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= samples)
    text = F.concat_ws(";", *[F.when(F.col("_m")[i].isNotNull(), F.concat(F.lit(f"{n}="), F.col("_m")[i].cast("string"))) for i, n in enumerate(BOUNDS)])
    return per.select(key, text.alias("changes"), "try", "moved", "k")


def rule_signature() -> Column:
    """Hash of what a rule executes: narrative and unused parameters do not count."""
    keep = lambda n: F.when(_inactive(n), F.lit("-")).otherwise(_fixed(F.col(n)))
    parts = [F.col("family"), F.col("regime"), F.col("confirmation"), *[keep(n) for n in BOUNDS]]
    return F.sha2(F.concat_ws("|", *parts), 256)


def rule_dedupe(rules: DataFrame, key: str) -> DataFrame:
    """One row per distinct executable rule: the first key and how many share it."""
    return rules.groupBy(rule_signature().alias("signature")).agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))


def variant_grid(index: DataFrame, key: str) -> DataFrame:
    """A spread of rule variants from their index: families in turn, low-discrepancy sizes."""
    i = F.col(key)
    cycle = F.floor(i / len(FAMILIES))
    slow = 20 + cycle * 17 % 131
    fast = 2 + F.pmod(cycle * 7 + 8, F.least(F.lit(39), slow - 2))
    stop = 0.01 + 0.005 * (cycle % 20)
    # Binary digits of cycle + 1 mirrored at the point.
    bits = F.split(F.reverse(F.bin(cycle + 1)), "")
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.5).alias("u"))
    mirrored = F.aggregate(bits, zero, lambda a, b: F.struct((a["v"] + F.when(b == "1", a["u"]).otherwise(0.0)).alias("v"), (a["u"] / 2).alias("u")), lambda a: a["v"])
    return index.select(
        key, F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (i % len(FAMILIES) + 1).cast("int")).alias("family"), fast.alias("fast"), slow.alias("slow"),
        (0.5 + (cycle * 11 % 26) / 10).alias("threshold"), (0.6 + 0.35 * mirrored).alias("allocation"), stop.alias("stop_loss"), (2 * stop).alias("take_profit"),
        F.least(F.lit(100), F.greatest(F.lit(5), F.floor(slow / 2))).alias("max_holding"))


def trial_count(log: DataFrame) -> DataFrame:
    """Trials charged so far, from the append-only log."""
    return log.filter(F.col("kind").isin("MIGRATION_BASELINE", "TRIAL_RESERVED")).agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("trials"))


def trial_budget(trials: DataFrame, limit: int = 3) -> DataFrame:
    """May another variant of a structure be tried in a scope, and if not why."""
    pending = F.sum(F.when(F.coalesce(F.col("outcome") != "REJECTED", F.lit(True)), 1).otherwise(0))
    a = trials.groupBy("scope", "structure").agg(F.count(F.lit(1)).alias("tried"), pending.alias("pending"))
    reason = F.when(F.col("tried") >= limit, F.lit("exhausted")).when(F.col("pending") > 0, F.lit("pending_or_approved")).otherwise(F.lit("open"))
    return a.withColumn("verdict", reason)


def chain_breaks(log: DataFrame, order: str, fields: list[str], parent: str = "parent", digest: str = "event_hash", slot_rows: int = 1 << 16) -> DataFrame:
    """Entries whose hash does not cover their fields or whose parent is not the entry before."""
    seen = blocks.with_previous(log, [], [order], {"_before": digest}, slot=F.floor(F.col(order) / slot_rows))
    own = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    broken = F.array_compact(F.array(
        F.when(F.col(digest) != own, F.lit("content")),
        F.when(F.coalesce(F.col(parent), F.lit("")) != F.coalesce("_before", F.lit("")), F.lit("parent"))))
    return seen.select(order, F.explode(broken).alias("problem"))


# Where each rejection reason of this library points.
CATEGORY_OF = {
    "too_few_trades": "insufficient_evidence", "insufficient_history": "insufficient_evidence",
    "cost_stress": "costs",
    "parameter_stress": "parameter_fragility",
    "walk_forward": "instability", "forward_windows": "instability", "bootstrap": "instability", "execution_delay": "instability",
    "deflated_sharpe": "weak_evidence", "sequential_evidence": "weak_evidence", "sharpe_or_degradation": "weak_evidence",
    "return_or_drawdown": "weak_evidence", "profit_factor": "weak_evidence", "benchmark": "weak_evidence",
}


def failure_categories(results: DataFrame, key: str) -> DataFrame:
    """Categories of each result's reasons (array of reason names), as one row per category.

    A reason this library does not give is ``other``. A result whose orders were all skipped points at
    the execution limits as well.
    """
    of = F.create_map(*[F.lit(x) for pair in CATEGORY_OF.items() for x in pair])
    named = F.array_distinct(F.transform("reasons", lambda r: F.coalesce(F.try_element_at(of, r), F.lit("other"))))
    limits = F.when((F.col("skipped_orders") > 0) & (F.col("trades") == 0), F.array(F.lit("execution_limits"))).otherwise(F.array().cast("array<string>"))
    return results.select(key, F.explode(F.concat(limits, named)).alias("category"))


def asset_verdicts(results: DataFrame) -> DataFrame:
    """Profitability and robustness labels of each asset."""
    profit = F.when(F.col("net_return").isNull(), F.lit("NOT_EVALUATED")).when((F.col("net_return") > 0) & (F.col("trades") > 0), F.lit("POSITIVE")).otherwise(F.lit("NO_TRADABLE_GAIN"))
    robust = F.when(F.col("complete"), F.lit("PASSED")).when(F.col("net_return").isNotNull(), F.lit("NOT_PASSED")).otherwise(F.lit("NOT_EVALUATED"))
    return results.select("asset", profit.alias("profitability"), robust.alias("robustness"))


def rank_assets(results: DataFrame, keys: list[str]) -> DataFrame:
    """The best asset per group by (all passed, quant passed, Sharpe, -drawdown, return)."""
    order = F.struct((F.col("quant_passed") & F.col("stress_passed")).alias("a"), F.col("quant_passed").alias("b"), F.col("sharpe").alias("c"),
                     (-F.col("max_drawdown")).alias("d"), F.col("net_return").alias("e"), F.col("asset").alias("f"))
    return results.groupBy(*keys).agg(F.max(order).alias("_o")).select(*keys, F.col("_o.f").alias("selected"), F.col("_o.c").alias("sharpe"))


def recent_notes(notes: DataFrame, trials: DataFrame, count: int = 12) -> DataFrame:
    """The newest notes with the scope of the trial they belong to."""
    newest = notes.orderBy(F.desc("id")).limit(count)
    return newest.join(trials.select("run", "attempt", "scope"), ["run", "attempt"], "left")


def scorecard(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Frozen candidates against their later results."""
    j = candidates.join(results, "candidate", "left")
    return j.groupBy("asset").agg(
        F.count(F.lit(1)).alias("frozen"), F.count("passed").alias("completed"), (F.count(F.lit(1)) - F.count("passed")).alias("pending"),
        F.count(F.when(F.col("passed"), 1)).alias("passed"), F.avg("forward_sharpe").alias("mean_forward_sharpe"))


def holdout_cutoff(scopes: DataFrame, consumed: DataFrame, planned: str) -> DataFrame:
    """The next holdout starts after the latest consumed end, else at the planned time."""
    last = consumed.groupBy("scope").agg(F.max("end").alias("_end"))
    p = F.lit(planned).cast("timestamp")
    return scopes.select("scope").distinct().join(last, "scope", "left").select("scope", F.greatest(F.coalesce("_end", p), p).alias("cutoff"))
