"""From quotes to the fills a trend rule would have asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals, ta
from ..operators import blocks, resample
from .backtest import positioned


def trend_fills(quotes: DataFrame, seconds: int, fast: int, slow: int, friction: float = 6e-4) -> DataFrame:
    """Fills and mean price per asset: decided at a bar's close, bought at the next open."""
    bars = positioned(resample.signal_bars(quotes, seconds, "mid"), ["asset"])
    entry = signals.entry("trend", fast, slow)
    features = {"entry": entry, "before": ta.signal(ta.lag(entry, 1))}
    rows = ta.evaluate(bars, features, ["asset"], ["ts"], position="rn")
    # The fill belongs to the next bar: shift the fresh signal forward, not the price back.
    fresh = blocks.with_previous(rows.withColumn("fresh", F.col("entry") & ~F.col("before")), ["asset"], ["ts"], {"bought": "fresh"}, position="rn")
    fills = fresh.filter("bought").withColumn("price", F.col("open") * (1 + friction))
    return fills.groupBy("asset").agg(F.count(F.lit(1)).alias("fills"), F.avg("price").alias("mean_price"))
