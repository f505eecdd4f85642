"""Odd sketches of whole sets: a bit a group, for more groups than shingles, that says whether the group's number of shingles is odd.

What two sets share cancels in the XOR, so the bits left never outnumber the shingles that are in one set only: a sure bound, which leaves no link out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

#: Bits of an odd sketch: the power of two from twice the set's size on, within these.
BRIEF_BITS, ODD_BITS = 512, 1 << 14


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each of many groups, as 64-bit words: whether its number of shingles is odd. What two sets share cancels in the XOR."""
    bits = min(max(BRIEF_BITS, 1 << max(0, 2 * len(s) - 1).bit_length()), ODD_BITS)
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def halved(x: str, both):
    """A vector of half as many groups: group g of them is made of g and g + half."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), both)


def total(x: str, y: str, halve, each):
    """The sum of ``each`` over two vectors, the longer one halved; null where they differ by more than twice: sets of such sizes never link."""
    wide = lambda p, q: F.size(p) > F.size(q)
    a, b = F.when(wide(x, y), halved(x, halve)).otherwise(F.col(x)), F.when(wide(y, x), halved(y, halve)).otherwise(F.col(y))
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, each), F.lit(0), lambda n, v: n + v))


def sizes_fit(threshold: int):
    """Can sets of sizes size_a and size_b link?"""
    return F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * threshold


def odd_fits(differ, threshold: int):
    """Can sets whose odd sketches differ in so many bits link? As many shingles at least are in one of them only."""
    sizes = F.col("size_a") + F.col("size_b")
    return (sizes - differ) * (100 + threshold) >= 2 * threshold * sizes


def odd_may_link(threshold: int):
    """Can sets with the columns size_a, odd_a and those of b link?"""
    differ = total("odd_a", "odd_b", lambda x, y: x.bitwiseXOR(y), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return sizes_fit(threshold) & odd_fits(F.coalesce(differ, F.lit(0)), threshold)
