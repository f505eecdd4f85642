"""Ranks and quantiles of trailing windows by a wavelet matrix: a logarithmic number of array steps for all rows of a block at once.

A block's values become dense ranks, and the matrix holds one level per bit of a rank: how many zeros of that bit come before each place,
after the rows were split stably by the higher bits. A window is a stretch of places; going down the levels with both of its ends
counts the values below any rank, or picks the k-th smallest, without looking at the window's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        """``values``: integers in [0, 2**bits)."""
        self.bits, self.zeros, self.split = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = (values >> level) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            self.split.append(len(values) - int(one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def below(self, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values in [start, end) are less than, and equal to, ``value``."""
        less = np.zeros(len(start), np.int64)
        for level, zeros, split in zip(range(self.bits - 1, -1, -1), self.zeros, self.split):
            z0, z1 = zeros[start], zeros[end]
            one = (value >> level) & 1 == 1
            less += np.where(one, z1 - z0, 0)
            start, end = np.where(one, split + start - z0, z0), np.where(one, split + end - z1, z1)
        return less, (end - start).astype(np.int64)

    def kth(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in [start, end)."""
        out = np.zeros(len(start), np.int64)
        for level, zeros, split in zip(range(self.bits - 1, -1, -1), self.zeros, self.split):
            z0, z1 = zeros[start], zeros[end]
            one = k >= z1 - z0
            k = np.where(one, k - (z1 - z0), k)
            out |= one.astype(np.int64) << level
            start, end = np.where(one, split + start - z0, z0), np.where(one, split + end - z1, z1)
        return out


def trailing(values: np.ndarray, n: int, quantiles: list[float], ranked: bool) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """The average-tie rank of each value as a fraction, and quantiles (linear), over n rows up to it; NaN where one of them is missing."""
    rows, out = len(values), np.full(len(values), np.nan)
    seen = np.r_[0, np.cumsum(~np.isnan(values))]
    end = np.arange(1, rows + 1)
    full = np.flatnonzero((end >= n) & (seen[end] - seen[np.maximum(end - n, 0)] == n))
    rank, picked = out.copy() if ranked else None, [out.copy() for _ in quantiles]
    if not len(full):
        return rank, picked
    distinct, code = np.unique(values, return_inverse=True)  # NaN is the last one, and in no full window
    tree = WaveletMatrix(code.astype(np.int64), max(1, int(len(distinct) - 1).bit_length()))
    start, end = full + 1 - n, full + 1
    if ranked:
        less, same = tree.below(start, end, code[full])
        rank[full] = (less + (same + 1) / 2) / n
    for q, to in zip(quantiles, picked):
        at = q * (n - 1)
        low = int(np.floor(at))
        k = np.full(len(full), low)
        a = distinct[tree.kth(start, end, k)]
        b = distinct[tree.kth(start, end, k + 1)] if at > low else a
        to[full] = a + (b - a) * (at - low)
    return rank, picked


def grouped(value: str, place: str, n: int, names: dict[str, float | None]):
    """A function for ``applyInArrow``: adds the columns ``names`` (name -> quantile, or None for the rank) to a block's rows."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[place].to_numpy(), kind="stable")
        values = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)[order].astype(np.float64)
        rank, picked = trailing(values, n, [q for q in names.values() if q is not None], any(q is None for q in names.values()))
        left = iter(picked)
        for name, q in names.items():
            new = np.empty(len(values))
            new[order] = rank if q is None else next(left)
            table = table.append_column(name, pa.array(new, mask=np.isnan(new)))
        return table

    return run
