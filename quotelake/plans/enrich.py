"""Bars widened with all that was known when each one opened."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import asof
from ..operators.resample import calendar_columns
from ..session import stage


def enrich(bars: DataFrame, sources: list[str], fields: list[str], bar_seconds: int, external: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Calendar columns, each source's latest closed bar, and external series within their age.

    ``external``: name -> (table of available_at and value, days a value stays usable).
    """
    out = stage(asof.cross_market(calendar_columns(bars), sources, fields, bar_seconds))
    for name, (series, days) in external.items():
        known = series.withColumnRenamed("value", name)
        out = asof.asof(out, known, [], "ts", "available_at", [name], strict=True, tolerance_seconds=days * 86400, prefix="external_")
    return out
