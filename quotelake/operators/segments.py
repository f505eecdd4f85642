"""Calendar segments, reference traces and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import micros


def _cut(a: Column, b: Column, share: float, grid: int | None) -> Column:
    us = micros(a) + F.floor((micros(b) - micros(a)) * F.lit(share)).cast("long")
    if grid:
        us = us - F.pmod(us, F.lit(grid * 1_000_000))
    return F.timestamp_micros(us)


def calendar_segments(bounds: DataFrame, grid: int | None = None) -> DataFrame:
    """60/20/20 by calendar from (asset, start, end): discovery, validation, holdout."""
    return bounds.select(
        "asset", "start", _cut(F.col("start"), F.col("end"), 0.6, grid).alias("validation"),
        _cut(F.col("start"), F.col("end"), 0.8, grid).alias("holdout"), "end",
    )


def assign_segment(rows: DataFrame, segments: DataFrame) -> DataFrame:
    seg = (
        F.when(F.col("ts") < F.col("validation"), "training").when(F.col("ts") < F.col("holdout"), "validation")
        .otherwise("holdout")
    )
    return rows.join(segments, "asset").withColumn("segment", seg).drop("start", "validation", "holdout", "end")


def common_partition(bars: DataFrame) -> DataFrame:
    """Shared cut-offs over all assets: 80 % discovery, of which 75 % trains."""
    per = bars.groupBy("asset").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = per.agg(F.max("a").alias("start"), F.min("b").alias("end"))
    cutoff = span.withColumn("cutoff", _cut(F.col("start"), F.col("end"), 0.8, None))
    return cutoff.withColumn("training_end", _cut(F.col("start"), F.col("cutoff"), 0.75, None))


def partition_counts(bars: DataFrame, discovery_min: int = 600, holdout_min: int = 120) -> DataFrame:
    p = bars.crossJoin(F.broadcast(common_partition(bars)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = p.groupBy("asset").agg(
        n(F.col("ts") < F.col("training_end")).alias("training_bars"),
        n((F.col("ts") >= F.col("training_end")) & (F.col("ts") < F.col("cutoff"))).alias("validation_bars"),
        n(F.col("ts") >= F.col("cutoff")).alias("holdout_bars"),
    )
    enough = (F.col("training_bars") + F.col("validation_bars") >= discovery_min) & (F.col("holdout_bars") >= holdout_min)
    return out.withColumn("enough", enough)


def reconcile(reference: DataFrame, observed: DataFrame, keys: list[str], numeric: list[str], exact: list[str],
              atol: float) -> DataFrame:
    """One row: rows missing, extra, duplicated, and mismatches per column."""
    wanted = [*keys, *numeric, *exact]
    r = reference.select(*wanted).withColumn("_side", F.lit("r"))
    o = observed.select(*wanted).withColumn("_side", F.lit("o"))
    side = lambda s: F.col("_side") == s
    n = lambda s: F.count(F.when(side(s), 1))
    # Counting both sides in one aggregate needs a single shuffle and no join.
    g = r.unionByName(o).groupBy(*keys).agg(
        n("r").alias("_r"), n("o").alias("_o"),
        *[F.min(F.when(side(s), F.col(c))).alias(f"{s}_{c}") for s in "ro" for c in [*numeric, *exact]],
    )
    both = (F.col("_r") == 1) & (F.col("_o") == 1)
    far = lambda c: F.coalesce(~(F.abs(F.col(f"r_{c}") - F.col(f"o_{c}")) <= atol), F.lit(True))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    out = g.agg(
        F.coalesce(F.sum("_r"), F.lit(0)).alias("expected_rows"), F.coalesce(F.sum("_o"), F.lit(0)).alias("observed_rows"),
        count((F.col("_r") > 0) & (F.col("_o") == 0)).alias("missing"),
        count((F.col("_o") > 0) & (F.col("_r") == 0)).alias("extra"),
        count((F.col("_r") > 1) | (F.col("_o") > 1)).alias("duplicated"),
        *[count(both & far(c)).alias(f"mismatch_{c}") for c in numeric],
        *[count(both & ~F.col(f"r_{c}").eqNullSafe(F.col(f"o_{c}"))).alias(f"mismatch_{c}") for c in exact],
    )
    bad = F.lit(0)
    for c in ["missing", "extra", "duplicated", *[f"mismatch_{c}" for c in [*numeric, *exact]]]:
        bad = bad + F.col(c)
    return out.withColumn("passed", (bad == 0) & (F.col("expected_rows") > 0))


def resolve_settings(assets: DataFrame, profiles: DataFrame, overrides: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Override, else profile, else default, for each asset."""
    o, p = overrides.alias("o"), profiles.alias("p")
    joined = assets.alias("a").join(p, "asset", "left").join(o, "asset", "left")
    pick = []
    for name, value in defaults.items():
        options = [F.col(f"{t}.{name}") for t, df in (("o", overrides), ("p", profiles)) if name in df.columns]
        pick.append(F.coalesce(*options, F.lit(float(value))).alias(name))
    return joined.select("asset", *pick)


def scenario_grid(assets: DataFrame, rules: DataFrame, multipliers: list[float], segments: list[str]) -> DataFrame:
    """Every asset with every rule variant, cost multiplier and segment.

    The rule and scenario dimensions are parameters, small by construction.
    """
    m = F.explode(F.array(*[F.lit(float(x)) for x in multipliers]))
    s = F.explode(F.array(*[F.lit(x) for x in segments]))
    return assets.select("asset").crossJoin(F.broadcast(rules)).withColumn("cost_multiplier", m).withColumn("segment", s)
