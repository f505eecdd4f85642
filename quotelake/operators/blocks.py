"""Ordered series cut into blocks of bounded size.

A window partitioned by asset alone puts an asset's whole history into one task. Here an
ordered series is cut into blocks along its order instead. The cut comes from row counts
per *slot* (an hour, a day, a range of sequence numbers), a small aggregate computed with
map-side combine from the key columns only. Slots are packed into blocks of about
``block_rows`` rows, and each block also receives the slots that hold the ``lookback`` rows
just before it, so a trailing window computed inside a block is exact. One shuffle of the
wide rows, by (keys, block), serves all windows that follow.

The packing depends on counts only, so a lost executor recomputes the same blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.guards import micros

BLOCK_ROWS = 1 << 18
BROADCAST_SLOTS = 200_000
# Slot widths tried from coarse to fine until the fullest slot fits in a block.
SLOT_SECONDS = (86_400, 3_600, 60, 1)

BLOCK, OWN, BASE = "_block", "_own", "_base"
# The usual name of the column :func:`with_row_number` adds.
POSITION = "rn"


@dataclass(frozen=True)
class Blocked:
    """Rows of a series with their block; halo rows carry ``_own`` = false."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def group(self) -> list[str]:
        return [*self.keys, BLOCK]

    def window(self, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*order)

    def own(self, df: DataFrame | None = None) -> DataFrame:
        """Drop the halo and the helper columns."""
        return (self.df if df is None else df).filter(F.col(OWN)).drop(BLOCK, OWN, BASE)


def time_slot(axis: Column, seconds: int) -> Column:
    us = F.lit(seconds * 1_000_000)
    return ((axis - F.pmod(axis, us)) / us).cast("long")


def _slot_counts(df: DataFrame, keys: list[str], slot: Column) -> DataFrame:
    return df.groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))


def split(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lookback: int = 0,
    slot: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    axis: Column | None = None,
    position: str | None = None,
) -> Blocked:
    """Cut ``df`` into blocks per key along ``order``.

    ``position`` names a column with a row's exact, gapless position in its series, if the
    caller has one; blocks are then plain arithmetic, nothing is counted and nothing joined.
    A NULL key is a series of its own and a row with a NULL order value stays in it.

    ``order[0]`` is the timestamp the slots are taken from. ``axis`` gives the same in
    microseconds where it is not a timestamp; ``slot`` gives another integer expression
    that never decreases along the order. ``lookback`` rows before a
    block are repeated in it; it may exceed ``block_rows``, which then grows with it.
    """
    if position is not None:
        return split_dense(df, keys, order, F.col(position), lookback, block_rows)
    block_rows = max(block_rows, lookback)
    widths = SLOT_SECONDS if slot is None else (None,)
    for seconds in widths:
        expr = time_slot(micros(F.col(order[0])) if axis is None else axis, seconds) if seconds else slot
        counts = _slot_counts(df, keys, expr)
        slots, fullest = counts.agg(F.count(F.lit(1)), F.max("_n")).first()
        if not fullest or fullest <= block_rows:
            break
    w = Window.partitionBy(*keys).orderBy("_slot")
    start = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.floor(F.col(BASE) / F.lit(block_rows))
    end = F.col(BASE) + F.col("_n")
    placed = counts.withColumn(BASE, start).withColumn("_home", own)
    if lookback:
        first = F.floor(end / F.lit(block_rows))
        last = F.floor((end + F.lit(lookback - 1)) / F.lit(block_rows))
        target = F.array_union(F.array(F.col("_home")), F.sequence(first, last))
        placed = placed.withColumn("_to", target)
    else:
        placed = placed.withColumn("_to", F.array(F.col("_home")))
    placed = placed.drop("_n")
    if slots <= BROADCAST_SLOTS:
        placed = F.broadcast(placed)
    rows = (
        null_safe_join(df.withColumn("_slot", expr), placed, [*keys, "_slot"], "inner")
        .withColumn(BLOCK, F.explode("_to"))
        .withColumn(OWN, F.col(BLOCK) == F.col("_home"))
        .drop("_slot", "_to", "_home")
    )
    return Blocked(rows, tuple(keys), tuple(order))


def split_dense(
    df: DataFrame, keys: list[str], order: list[str], axis: Column, lookback: int = 0, block_rows: int = BLOCK_ROWS
) -> Blocked:
    """Blocks along an integer axis on which a key has a bounded number of rows per step."""
    block_rows = max(block_rows, lookback)
    home = F.floor(axis / F.lit(block_rows))
    if not lookback:
        rows = df.withColumn(BLOCK, home).withColumn(OWN, F.lit(True)).withColumn(BASE, axis)
        return Blocked(rows, tuple(keys), tuple(order))
    tail = F.pmod(axis, F.lit(block_rows)) >= block_rows - lookback
    rows = (
        df.withColumn(BASE, axis)
        .withColumn(BLOCK, F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn(OWN, F.col(BLOCK) == F.floor(F.col(BASE) / F.lit(block_rows)))
    )
    return Blocked(rows, tuple(keys), tuple(order))


def with_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rn",
    slot: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact 0-based position per key, computed block by block."""
    b = split(df, keys, order, 0, slot, block_rows)
    w = b.window()
    base = F.first(BASE).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.own(b.df.withColumn(name, base + F.row_number().over(w) - 1))


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, Column | str],
    slot: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    position: str | None = None,
) -> DataFrame:
    """Add the value each expression had on the previous row of the series."""
    b = split(df, keys, order, 1, slot, block_rows, position=position)
    w = b.window()
    new = {n: F.lag(F.col(c) if isinstance(c, str) else c).over(w) for n, c in columns.items()}
    return b.own(b.df.withColumns(new))


def carried(b: Blocked, summaries: dict[str, Column], merge: dict[str, str]) -> DataFrame:
    """Attach to each row the summary of all blocks before its own.

    ``summaries`` are aggregates per block; ``merge`` says how the earlier blocks combine:
    ``sum``, ``max``, ``min`` or ``last`` (latest non-null). The table that crosses blocks
    has one row per block.
    """
    per_block = b.df.filter(F.col(OWN)).groupBy(*b.group).agg(*[c.alias(n) for n, c in summaries.items()])
    before = Window.partitionBy(*b.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    how = {
        "sum": lambda n: F.sum(n).over(before),
        "max": lambda n: F.max(n).over(before),
        "min": lambda n: F.min(n).over(before),
        "last": lambda n: F.last(n, ignorenulls=True).over(before),
    }
    prefix = per_block.select(*b.group, *[how[merge[n]](n).alias(n) for n in summaries])
    return null_safe_join(b.df, prefix, b.group, "left")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """An equi-join in which NULL equals NULL."""
    other = {c: f"_on_{c}" for c in on}
    right = right.withColumnsRenamed(other)
    test = F.lit(True)
    for c, o in other.items():
        test = test & left[c].eqNullSafe(right[o])
    return left.join(right, test, how).drop(*other.values())
