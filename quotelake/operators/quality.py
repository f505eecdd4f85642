"""Checks on quotes and bars. Each returns a table of violations or metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import finite, floor_ts, micros
from . import blocks
from .quantiles import exact_quantiles

# A quote day is flagged beyond these.
SPREAD_BPS_LIMIT = 50.0
GAP_SECONDS_LIMIT = 300.0
JUMP_LIMIT = 0.02
# Supported bar lengths in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def _reasons(df: DataFrame, checks: dict[str, Column], keep: list[str]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return df.select(*keep, F.explode(found).alias("reason"))


def _not_finite(*cs: str) -> Column:
    bad = F.lit(False)
    for c in cs:
        bad = bad | finite(F.col(c)).isNull()
    return bad


def quote_violations(df: DataFrame, arrival: str = "arrival", slot_rows: int = 1 << 16) -> DataFrame:
    """One row per broken rule of a quote, in arrival order per asset."""
    seen = blocks.with_previous(
        df, ["asset"], [arrival], {"_pts": "ts", "_pseq": "sequence"}, slot=F.floor(F.col(arrival) / slot_rows)
    )
    checks = {
        "missing_time": F.col("ts").isNull(),
        "bad_sequence": F.col("sequence").isNull() | (F.col("sequence") < 0),
        "time_backwards": F.col("ts") < F.col("_pts"),
        "sequence_not_increasing": (F.col("ts") == F.col("_pts")) & (F.col("sequence") <= F.col("_pseq")),
        "not_finite": _not_finite("bid", "ask"),
        "not_positive": (F.col("bid") <= 0) | (F.col("ask") <= 0),
        "crossed": finite(F.col("bid")) > finite(F.col("ask")),
    }
    return _reasons(seen, checks, ["asset", arrival])


def bar_violations(df: DataFrame, arrival: str = "arrival", minimum: int = 600, slot_rows: int = 1 << 16) -> DataFrame:
    """One row per broken rule of a bar, and one per asset with too little history."""
    seen = blocks.with_previous(df, ["asset"], [arrival], {"_pts": "ts"}, slot=F.floor(F.col(arrival) / slot_rows))
    top = F.greatest("open", "high", "low", "close")
    bottom = F.least("open", "high", "low", "close")
    checks = {
        "missing_time": F.col("ts").isNull(),
        "duplicate_time": F.col("ts") == F.col("_pts"),
        "time_backwards": F.col("ts") < F.col("_pts"),
        "not_finite": _not_finite("open", "high", "low", "close"),
        "not_positive": F.least("open", "high", "low", "close") <= 0,
        "high_too_low": F.col("high") < top,
        "low_too_high": F.col("low") > bottom,
    }
    names = set(df.columns)
    if "volume" in names:
        checks["negative_volume"] = F.col("volume") < 0
    sides = ["bid_open", "ask_open", "bid_close", "ask_close"]
    if set(sides) & names:
        if not set(sides) <= names:
            raise ValueError("observed quotes need open and close of both sides")
        checks["bad_observed_quotes"] = (
            _not_finite(*sides)
            | (F.least(*sides) <= 0)
            | (F.col("ask_open") < F.col("bid_open"))
            | (F.col("ask_close") < F.col("bid_close"))
        )
    for cost in ("spread_bps", "slippage_bps", "holding_cost_bps"):
        if cost in names:
            checks[f"bad_{cost}"] = finite(F.col(cost)).isNull() | (F.col(cost) < 0)
    short = df.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < minimum)
    return _reasons(seen, checks, ["asset", arrival]).unionByName(
        short.select("asset", F.lit(None).cast("long").alias(arrival), F.lit("too_few_bars").alias("reason"))
    )


def quote_day_metrics(quotes: DataFrame, issues: DataFrame | None = None,
                      spread_limit: float = SPREAD_BPS_LIMIT, gap_limit: float = GAP_SECONDS_LIMIT,
                      jump_limit: float = JUMP_LIMIT, closed_days: DataFrame | None = None) -> DataFrame:
    """Quality of each asset-day: extremes, repeated quotes, flags and status.

    ``issues`` (asset, day, issue) adds outside findings such as missing hours.
    ``closed_days`` (asset, day) lists empty Saturdays whose 24 hours were all closed.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = quotes.withColumn("day", F.to_date("ts")).withColumn("_mid", mid)
    rows = rows.withColumn("spread", (F.col("ask") - F.col("bid")) / F.col("_mid") * 10000)
    lagged = blocks.with_previous(rows, ["asset", "day"], ["ts", "sequence"], {"_pts": "ts", "_pmid": "_mid"})
    gap = (micros(F.col("ts")) - micros(F.col("_pts"))) / 1e6
    jump = F.abs(F.col("_mid") / F.col("_pmid") - 1)
    base = lagged.groupBy("asset", "day").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.max("spread").alias("spread_bps_max"),
        F.max(gap).alias("gap_seconds_max"),
        F.max(jump).alias("price_jump_max"),
    )
    p99 = exact_quantiles(rows, ["asset", "day"], "spread", {"spread_bps_p99": 0.99})
    copies = (
        quotes.groupBy("asset", "ts", "bid", "ask")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("asset", F.to_date("ts").alias("day"))
        .agg(F.sum(F.col("_c") - 1).alias("repeated_quotes"))
    )
    joined = base.join(p99, ["asset", "day"]).join(copies, ["asset", "day"])
    few = F.col("ticks") < 2
    for c in ("spread_bps_max", "spread_bps_p99", "gap_seconds_max", "price_jump_max"):
        joined = joined.withColumn(c, F.when(~few, F.col(c)))
    flags = F.array_compact(
        F.array(
            F.when(few, F.lit("fewer_than_two_ticks")),
            F.when(F.col("gap_seconds_max") > gap_limit, F.lit("gap")),
            F.when(F.col("price_jump_max") > jump_limit, F.lit("jump")),
            F.when(F.col("spread_bps_max") > spread_limit, F.lit("spread")),
        )
    )
    if issues is not None:
        more = issues.groupBy("asset", "day").agg(F.collect_set("issue").alias("_more"))
        joined = joined.join(more, ["asset", "day"], "left")
        flags = F.array_sort(F.array_union(flags, F.coalesce("_more", F.array().cast("array<string>"))))
        joined = joined.withColumn("issues", flags).drop("_more")
    else:
        joined = joined.withColumn("issues", flags)
    status = F.when(F.size("issues") > 0, F.lit("NEEDS_REVIEW")).otherwise(F.lit("PASSED"))
    out = joined.withColumn("status", status)
    if closed_days is not None:
        empty = closed_days.select("asset", "day").join(out, ["asset", "day"], "left_anti")
        out = out.unionByName(
            empty.select("asset", "day", F.lit(0).cast("long").alias("ticks"),
                         F.array().cast("array<string>").alias("issues"), F.lit("CLOSED_WEEKEND").alias("status")),
            allowMissingColumns=True,
        )
    return out


def closed_weekend(ts: Column) -> Column:
    """Hours closed in summer and winter alike: Saturday, Sunday before 20, Friday from 23."""
    day, hour = F.weekday(ts), F.hour(ts)
    return (day == 5) | ((day == 6) & (hour < 20)) | ((day == 4) & (hour >= 23))


def weekend_hours(quotes: DataFrame) -> DataFrame:
    hours = quotes.groupBy("asset", floor_ts(F.col("ts"), 3600).alias("hour")).agg(F.count(F.lit(1)).alias("ticks"))
    return (
        hours.groupBy("asset", closed_weekend(F.col("hour")).alias("closed"))
        .agg(F.count(F.lit(1)).alias("hours"), F.sum("ticks").alias("ticks"))
    )


def day_calendar(assets: DataFrame, start: str, end: str) -> DataFrame:
    """Every asset on every UTC day of [start, end)."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    return assets.select("asset").distinct().select("asset", F.explode(days).alias("day"))


def hour_coverage(quotes: DataFrame, start: str, end: str) -> DataFrame:
    """Per asset-day: hours expected, present and missing (closed hours are not expected)."""
    hours = quotes.groupBy("asset", floor_ts(F.col("ts"), 3600).alias("hour")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.col("day").cast("timestamp")
    grid = day_calendar(quotes, start, end).select(
        "asset", "day",
        F.explode(F.sequence(first, first + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("hour"),
    )
    closed = closed_weekend(F.col("hour"))
    missing = F.when(~closed & F.col("_n").isNull(), F.date_format("hour", "HH"))
    return (
        grid.join(hours, ["asset", "hour"], "left")
        .groupBy("asset", "day")
        .agg(
            F.sum(F.when(closed, 0).otherwise(1)).alias("expected_hours"),
            F.sum(F.when(~closed & F.col("_n").isNotNull(), 1).otherwise(0)).alias("present_hours"),
            F.sum(F.when(closed, 1).otherwise(0)).alias("closed_hours"),
            F.concat_ws(",", F.array_sort(F.collect_list(missing))).alias("missing"),
        )
    )


def missing_days(catalog: DataFrame, start: str, end: str) -> DataFrame:
    return day_calendar(catalog, start, end).join(catalog.select("asset", "day"), ["asset", "day"], "left_anti")


def quality_gate(days: DataFrame) -> DataFrame:
    """An asset may be read only when each of its days passed or was a closed weekend."""
    bad = ~F.col("status").isin("PASSED", "CLOSED_WEEKEND")
    return days.groupBy("asset").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("blocked_days"),
        F.min(F.when(bad, F.col("day"))).cast("string").alias("first_blocked"),
        (F.sum(F.when(bad, 1).otherwise(0)) == 0).alias("readable"),
    )


def _gaps(bars: DataFrame) -> DataFrame:
    seen = blocks.with_previous(bars.select("asset", "ts"), ["asset"], ["ts"], {"_pts": "ts"})
    return seen.withColumn("diff", (micros(F.col("ts")) - micros(F.col("_pts"))) / 1_000_000)


def bar_frequency(bars: DataFrame) -> DataFrame:
    """Most frequent step between bars, the smallest on a tie; one day below two bars."""
    counts = _gaps(bars).groupBy("asset", F.col("diff").cast("long").alias("diff")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.col("diff"), F.when(F.col("diff").isNotNull(), F.struct(F.col("_n"), -F.col("diff"))))
    return (
        counts.groupBy("asset").agg(F.coalesce(best, F.lit(86400)).alias("seconds"))
        .withColumn("known", F.col("seconds").isin(*TIMEFRAMES.values()))
    )


def grid_alignment(bars: DataFrame, declared: int, as_of: str) -> DataFrame:
    """Do the bars sit on their declared grid, and is the last one closed?"""
    us = declared * 1_000_000
    rows = _gaps(bars)
    at = rows.groupBy("asset").agg(
        F.sum(F.when(F.pmod(micros(F.col("ts")), F.lit(us)) != 0, 1).otherwise(0)).alias("off_grid"),
        F.sum(F.when(F.pmod((F.col("diff") * 1_000_000).cast("long"), F.lit(us)) != 0, 1).otherwise(0)).alias("off_step"),
        F.max("ts").alias("_last"),
    )
    closed = micros(F.col("_last")) + us <= micros(F.lit(as_of).cast("timestamp"))
    return at.join(bar_frequency(bars), "asset").select(
        "asset", "off_grid", "off_step", (F.col("seconds") == declared).alias("step_as_declared"),
        closed.alias("last_closed"),
    )


def bar_coverage(bars: DataFrame, start: str, end: str, limit_days: int = 7) -> DataFrame:
    """Late start, stale end and inner gaps of each asset's bars, in whole days."""
    day = 86400
    a = _gaps(bars).groupBy("asset").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.floor(F.col("diff") / day)).alias("gap_days")
    )
    late = F.floor((micros(F.col("first")) - micros(F.lit(start).cast("timestamp"))) / (day * 1e6))
    stale = F.floor((micros(F.lit(end).cast("timestamp")) - micros(F.col("last"))) / (day * 1e6))
    a = a.withColumn("late_days", late).withColumn("stale_days", stale)
    ok = (F.col("gap_days") <= limit_days) & (F.col("late_days") <= limit_days) & (F.col("stale_days") <= limit_days)
    return a.withColumn("covered", ok)


def quote_gaps(quotes: DataFrame, start: str, end: str, max_gap_ms: int) -> DataFrame:
    """Longest silence inside [start, end), both edges included."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = quotes.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    seen = blocks.with_previous(rows.select("asset", "ts", "sequence"), ["asset"], ["ts", "sequence"], {"_pts": "ts"})
    us = micros(F.col("ts")) - micros(F.coalesce("_pts", lo))
    tail = micros(hi) - micros(F.max("ts"))
    return seen.groupBy("asset").agg(F.greatest(F.max(us), tail).alias("gap_us")).select(
        "asset", "gap_us", (F.col("gap_us") <= max_gap_ms * 1000).alias("passed")
    )


def coverage_check(quotes: DataFrame, contracts: DataFrame, as_of: str) -> DataFrame:
    """Declared coverage against the rows and the requested period (one contract per asset)."""
    outside = (F.col("ts") < F.col("coverage_start")) | (F.col("ts") >= F.col("coverage_end"))
    return (
        quotes.select("asset", "ts").join(contracts, "asset")
        .groupBy("asset")
        .agg(
            F.sum(F.when(outside, 1).otherwise(0)).alias("rows_outside"),
            F.sum(F.when(F.col("ts") > F.lit(as_of).cast("timestamp"), 1).otherwise(0)).alias("rows_in_future"),
            F.first((F.col("coverage_start") <= F.col("request_start")) & (F.col("coverage_end") >= F.col("request_end")))
            .alias("request_covered"),
        )
    )


def contract_mismatch(declared: DataFrame, requested: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields on which a dataset's contract and the request differ; absent contracts too."""
    d, r = declared.alias("d"), requested.alias("r")
    differs = F.array_compact(
        F.array(*[F.when(~F.col(f"d.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields])
    )
    return (
        r.join(d, F.col(f"d.{key}") == F.col(f"r.{key}"), "left")
        .select(
            F.col(f"r.{key}").alias(key),
            F.when(F.col(f"d.{key}").isNull(), F.lit("absent")).otherwise(F.concat_ws(",", differs)).alias("mismatch"),
        )
        .filter(F.col("mismatch") != "")
    )


def fingerprint(df: DataFrame, keys: list[str], row_text: Column) -> DataFrame:
    """Order-free content hash per key.

    The SHA-256 of each row is cut into four 60-bit numbers whose sums are hashed again, so
    the aggregate is combined map-side and no group is gathered.
    """
    h = F.sha2(row_text, 256)
    part = lambda i: F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(i)).cast("string") for i in range(4)]
    return (
        df.withColumn("_h", h).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums).alias("_s"))
        .select(*keys, "rows", F.sha2("_s", 256).alias("sha256"))
    )


def field_gaps(available: DataFrame, key: str, field: str, needed: list[str]) -> DataFrame:
    """Needed fields each target lacks (``available`` is long: one row per key and field)."""
    have = available.select(key, field).distinct().filter(F.col(field).isin(*needed))
    want = F.array(*[F.lit(n) for n in needed])
    every = available.select(key).distinct()
    return (
        every.join(have, key, "left")
        .groupBy(key)
        .agg(F.array_except(want, F.collect_set(field)).alias("_gap"))
        .select(key, F.concat_ws(",", F.array_sort("_gap")).alias("missing"))
    )


def column_catalogue(df: DataFrame, columns: list[str]) -> DataFrame:
    """Observations, coverage, mean and deviation of each column, in long form."""
    long = df.select(
        "asset",
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("v")) for c in columns]))
        .alias("e"),
    ).select("asset", "e.column", "e.v")
    n = F.count("v")
    return long.groupBy("asset", "column").agg(
        n.alias("observations"), (n / F.count(F.lit(1))).alias("coverage"), F.avg("v").alias("mean"),
        F.when(n > 1, F.stddev_samp("v")).alias("std"),
    )


def affordability(bars: DataFrame, settings: DataFrame, capital: float, allocation: float) -> DataFrame:
    """Can the allocated capital buy the instrument's smallest order in training?"""
    low = bars.groupBy("asset").agg(F.min("open").alias("min_open"))
    least = F.greatest(F.col("min_notional"), F.col("quantity_step") * F.col("min_open"))
    cost = least * (1 + F.col("commission_rate")) + F.col("fixed_commission")
    return low.join(settings, "asset").select("asset", cost.alias("required"), (F.lit(capital * allocation) >= cost).alias("affordable"))
