"""The whole way from a table of bars with signals to ledger, equity and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import ledger as lg
from ..operators import metrics
from ..session import stage


@dataclass(frozen=True)
class Run:
    rows: DataFrame
    ledger: DataFrame
    marks: DataFrame
    keys: list[str]

    def metrics(self, bars_per_year: float = 252.0) -> DataFrame:
        return metrics.run_metrics(self.marks, self.ledger, self.keys, bars_per_year, position="rn")

    def returns(self) -> DataFrame:
        return metrics.returns(self.marks, self.keys, position="rn")


def positioned(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with their position, written once; every later window is cut by it."""
    return stage(blocks.with_row_number(bars, keys, ["ts"]))


def run(bars: DataFrame, keys: list[str], params: dict | None = None, delay: int = 0, segments: DataFrame | None = None,
        bucket: int = 16) -> Run:
    """Backtest every run of the table at once; ``bars`` come from :func:`positioned`.

    ``segments`` (keys subset, segment, seg_from, seg_to) restricts rows to positions
    [seg_from, seg_to) and labels them, after the signals were placed, so earlier rows still warm the indicators; a bar may belong to
    several segments. Each segment starts in cash. ``max_holding`` is read from ``params``.
    """
    params = {**lg.DEFAULTS, **(params or {})}
    rows = lg.execution_rows(bars, keys, params, delay)
    if segments is not None:
        on = [c for c in segments.columns if c not in ("segment", "seg_from", "seg_to")]
        rows = (rows.join(segments, on) if on else rows.crossJoin(F.broadcast(segments))).filter(
            (F.col("rn") >= F.col("seg_from")) & (F.col("rn") < F.col("seg_to"))
        ).drop("seg_from", "seg_to")
        keys = [*keys, "segment"]
    rows = stage(rows)
    book = stage(lg.trade_ledger(lg.priced_candidates(rows, keys, params, int(params["max_holding"]), bucket), keys))
    marks = stage(lg.equity_marks(rows, book, keys, params))
    if not marks.filter("ruined").isEmpty():
        book = lg.settle_ruin(book, marks, rows, keys)
    return Run(rows, book, marks, keys)
