"""Quotes to bars, bars to coarser bars, and calendar shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import add_seconds, floor_ts, micros
from . import blocks

EVENT = ("ts", "sequence")


def _ohlc(price: Column, order: Column) -> list[Column]:
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
    ]


def side_price(side: str) -> Column:
    if side == "mid":
        return (F.col("bid") + F.col("ask")) / 2
    if side in ("bid", "ask"):
        return F.col(side)
    raise ValueError("a price side is bid, ask or mid")


def quotes_to_bars(quotes: DataFrame, seconds: int, side: str = "bid", start: str | None = None,
                   end: str | None = None) -> DataFrame:
    """Epoch-aligned OHLC bars; only buckets wholly inside [start, end)."""
    if start is not None:
        first = floor_ts(add_seconds(F.lit(start).cast("timestamp"), seconds) - F.expr("INTERVAL 1 MICROSECOND"), seconds)
        quotes = quotes.filter(F.col("ts") >= first)
    if end is not None:
        quotes = quotes.filter(F.col("ts") < floor_ts(F.lit(end).cast("timestamp"), seconds))
    bucket = floor_ts(F.col("ts"), seconds)
    return quotes.groupBy("asset", bucket.alias("bar_ts")).agg(*_ohlc(side_price(side), F.struct(*EVENT))).withColumnRenamed("bar_ts", "ts")


def signal_bars(quotes: DataFrame, seconds: int, side: str = "mid") -> DataFrame:
    """Bars for decisions: the first bucket is dropped unless quotes cover its start."""
    bars = quotes_to_bars(quotes, seconds, side)
    first = quotes.groupBy("asset").agg(F.min("ts").alias("_first"))
    return bars.join(first, "asset").filter(F.col("ts") >= F.col("_first")).drop("_first")


def rollup_complete(bars: DataFrame, base: int, target: int) -> DataFrame:
    """Coarser bars from finer ones; a bucket with a missing part is not built."""
    if target < base or target % base:
        raise ValueError("the target bar length must be a multiple of the base length")
    if target == base:
        return bars
    aggs = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close")]
    for c in bars.columns:
        if c == "volume":
            aggs.append(F.sum(c).alias(c))
        elif c not in ("asset", "ts", "open", "high", "low", "close"):
            aggs.append(F.max_by(c, "ts").alias(c))
    grouped = bars.groupBy("asset", floor_ts(F.col("ts"), target).alias("_bucket")).agg(
        *aggs, F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last")
    )
    whole = (F.col("_n") == target // base) & (F.col("_last") == add_seconds(F.col("_bucket"), target - base))
    return grouped.filter(whole).withColumnRenamed("_bucket", "ts").select(*bars.columns)


def timeframe_options(bars_seconds: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Signal timeframes each asset's bars can build (input: asset, seconds)."""
    dim = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(s).cast("long").alias("target")) for n, s in frames.items()])
    return (
        bars_seconds.select("asset", "seconds", F.explode(dim).alias("f"))
        .select("asset", "seconds", "f.timeframe", "f.target")
        .filter((F.col("target") >= F.col("seconds")) & (F.col("target") % F.col("seconds") == 0))
    )


def schedule(bars: DataFrame, decisions: DataFrame, base: int, target: int) -> DataFrame:
    """Place closed-bar decisions on the last bar they are made of.

    ``decisions`` has asset, ts (start of the signal bar), entry, exit, signal_price. Bars
    without a decision get false and a missing price.
    """
    at = decisions.select("asset", add_seconds(F.col("ts"), target - base).alias("ts"), "entry", "exit", "signal_price",
                          F.lit(True).alias("decision"))
    return bars.join(at, ["asset", "ts"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("entry", "exit", "decision")}
    )


def sunday_fold(bars: DataFrame, end: str | None = None) -> DataFrame:
    """Fold a Sunday session into Monday's bar."""
    moved = F.when(F.weekday("ts") == 6, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    out = bars.withColumn("_to", moved).groupBy("asset", "_to").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close")
    ).withColumnRenamed("_to", "ts")
    return out if end is None else out.filter(F.col("ts") < F.lit(end).cast("timestamp"))


def invert_ohlc(bars: DataFrame) -> DataFrame:
    """Bars of the inverse pair: the high comes from the low."""
    return bars.select(
        "asset", "ts", (1 / F.col("open")).alias("open"), (1 / F.col("low")).alias("high"),
        (1 / F.col("high")).alias("low"), (1 / F.col("close")).alias("close"),
    )


def common_range(bars: DataFrame) -> DataFrame:
    """Clip all assets to the calendar range they share."""
    per = bars.groupBy("asset").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = per.agg(F.max("a").alias("_from"), F.min("b").alias("_to"))
    return bars.crossJoin(F.broadcast(span)).filter(F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def grid_sample(
    marks: DataFrame, value: str, step: int, start: str, end: str, initial: float, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """The last mark strictly before each boundary of a UTC grid, else the initial value.

    Marks are reduced to one per grid interval map-side. The grid is made and filled in blocks of
    ``block_rows`` boundaries; what a block takes over from earlier ones is a table with a row per block.
    A NULL mark is no mark; a NULL asset is a series of its own. A range without a boundary gives no row.
    """
    us = step * 1_000_000
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    first = micros(floor_ts(lo, step)) + us
    last = F.ceil(micros(hi) / us) * us
    many = ((last - first) / us).cast("long") + 1
    block = lambda at: F.floor((at - first) / (us * block_rows))
    # A mark at b - 0 counts for boundary b; a mark on b counts for the next one.
    ends = micros(floor_ts(F.col("ts"), step)) + us
    latest = (
        marks.filter((F.col("ts") >= lo) & (F.col("ts") < hi) & F.col(value).isNotNull()).groupBy("asset", ends.alias("_at"))
        .agg(F.max_by(value, F.struct(*[c for c in EVENT if c in marks.columns])).alias("_v"))
    )
    parts = marks.select("asset").distinct().select(
        "asset", F.explode(F.when(many > 0, F.sequence(F.lit(0), F.floor((many - 1) / block_rows)))).alias("_part")
    )
    left = latest.groupBy("asset", block(F.col("_at")).alias("_part")).agg(F.max_by("_v", "_at").alias("_left"))
    earlier = Window.partitionBy("asset").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.null_safe_join(parts, left, ["asset", "_part"], "left").select(
        "asset", "_part", F.last("_left", ignorenulls=True).over(earlier).alias("_before")
    )
    own = F.sequence(F.col("_part") * block_rows, F.least((F.col("_part") + 1) * block_rows, many) - 1)
    grid = parts.withColumn("_k", F.explode(own)).withColumn("_at", first + F.col("_k") * us)
    w = Window.partitionBy("asset", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last("_v", ignorenulls=True).over(w), "_before", F.lit(float(initial)))
    return blocks.null_safe_join(grid, latest, ["asset", "_at"], "left").select(
        "asset", F.timestamp_micros("_at").alias("boundary"), filled.alias("value")
    )


def calendar_columns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({
        "weekday": F.weekday("ts").cast("double"), "month": F.month("ts").cast("double"),
        "day": F.dayofmonth("ts").cast("double"),
    })


def stressed_quotes(quotes: DataFrame, multiplier: float | Column) -> DataFrame:
    """Mid with the half spread scaled by a cost multiplier."""
    m = F.lit(multiplier) if not isinstance(multiplier, Column) else multiplier
    mid, half = (F.col("bid") + F.col("ask")) / 2, (F.col("ask") - F.col("bid")) / 2 * m
    return quotes.withColumn("mid", mid).withColumn("stressed_bid", mid - half).withColumn("stressed_ask", mid + half)


def curve_downsample(curve: DataFrame, keys: list[str], order: list[str], value: str, points: int = 800,
                     block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Even thinning to at most ``points`` rows, with the drawdown of the full curve."""
    b = blocks.split(curve, keys, order, block_rows=block_rows)
    rows = blocks.carried(b, {"_peak": F.max(value)}, {"_peak": "max"})
    run = b.window().rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max(value).over(run), F.coalesce("_peak", F.col(value)))
    pos = F.first(blocks.BASE).over(run) + F.row_number().over(b.window()) - 1
    rows = b.own(rows.withColumn("drawdown", 1 - F.col(value) / peak).withColumn("position", pos)).drop("_peak")
    n = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(n, keys)
    k = F.least(F.lit(points), F.col("_n"))
    # Keep p when some i in [0, k) has floor(i * (n - 1) / (k - 1)) = p.
    i = F.ceil(F.col("position") * (k - 1) / F.nullif(F.col("_n") - 1, F.lit(0)))
    hit = F.floor(i * (F.col("_n") - 1) / F.nullif(k - 1, F.lit(0))) == F.col("position")
    return joined.filter((F.col("_n") == 1) | hit).drop("_n")
