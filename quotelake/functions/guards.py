"""Missing-value rules: NULL is the only missing value, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL when the value is NaN or infinite (Spark orders NaN above every number)."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def required(value: Column, sound: Column, message: str) -> Column:
    """``value``, or a failed read where it is not sound."""
    return F.when(sound, value).otherwise(F.raise_error(F.lit(message)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing when b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the exact integer form of a timestamp."""
    return F.unix_micros(ts)


def floor_ts(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` holding ``ts``."""
    us = int(seconds) * 1_000_000
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(us)))


def add_seconds(ts: Column, seconds: int | Column) -> Column:
    sec = F.lit(int(seconds)) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(micros(ts) + sec.cast("long") * F.lit(1_000_000))


def ordered_mean(value: str, place: str) -> Column:
    """The mean of a group's doubles, added one after another by ``place``.

    A sum of doubles depends on its order, and a plain average on how rows happen to be split; where a mean meets a threshold (two
    discounts of 0.04 and 0.06 against 0.05) that decides. For groups that are small, such as the lines of an order.
    """
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(place).alias("p"), F.col(value).cast("double").alias("v")))))
    return F.aggregate(held, F.lit(0.0), lambda a, e: a + e["v"]) / F.nullif(F.size(held), F.lit(0))
