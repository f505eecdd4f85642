"""Counter-based random numbers in plain integer arithmetic.

A draw depends only on its coordinates (seed, path, position, ...), so any task can make
it, a retry makes the same one, and the formula can be written in any SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A Mersenne prime and the weights that spread the coordinates.
PRIME = 2_147_483_647
WEIGHTS = (7919, 104_729, 1_299_709, 15_485_863)


def draw(seed: int, *parts: Column) -> Column:
    """An integer in [0, PRIME) from up to four non-negative coordinates."""
    x = F.lit(seed).cast("long")
    for w, p in zip(WEIGHTS, parts):
        x = x + p.cast("long") % PRIME * w
    x = x % PRIME
    for k in (1, 2, 3):
        x = (x * x % PRIME + x * 48_271 % PRIME + k) % PRIME
    return x


def draw_sql(seed: int, *parts: str) -> str:
    """The same formula as SQL text."""
    x = "(" + " + ".join([str(seed), *[f"({p}) % {PRIME} * {w}" for w, p in zip(WEIGHTS, parts)]]) + f") % {PRIME}"
    for k in (1, 2, 3):
        x = f"list_transform([{x}], lambda v: (v * v % {PRIME} + v * 48271 % {PRIME} + {k}) % {PRIME})[1]"
    return f"CAST({x} AS BIGINT)"


def draws(seeds: list[int], slots: list[int]):
    """A function of two columns that makes the draws of all seeds and slots at once, as one array: seed by seed, slot by slot.

    As a Column a draw is repeated inside itself and again wherever a filter is pushed through it; this is made once a row.
    """

    def made(a: pa.Array, b: pa.Array) -> pa.Array:
        first = sum(np.fmod(c.to_numpy(zero_copy_only=False).astype("int64"), PRIME) * w for c, w in zip((a, b), WEIGHTS))
        out = np.empty((len(a), len(seeds) * len(slots)), "int64")
        for j, (seed, slot) in enumerate((s, i) for s in seeds for i in slots):
            x = np.fmod(first + (seed + slot % PRIME * WEIGHTS[2]), PRIME)
            for k in (1, 2, 3):
                x = np.fmod(np.fmod(x * x, PRIME) + np.fmod(x * 48_271, PRIME) + k, PRIME)
            out[:, j] = x
        return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype="int32") * out.shape[1], pa.array(out.ravel()))

    return F.arrow_udf(made, "array<bigint>").asNondeterministic()
