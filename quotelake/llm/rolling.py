"""Rabin-Karp hashes of every fixed-length window of words, with numpy, and compact byte forms of sorted numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: An odd multiplier; hashes are polynomials in it modulo 2**64 over well-mixed 64-bit word hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
KEPT = 150_000


class WordHashes(dict):
    """Word -> 64-bit hash. Remembers a bounded number of words; the others are hashed again."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT and len(word) < 64:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values: sum of h[i + j] * BASE**(k - 1 - j), built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done = None, 0  # hash of the first ``done`` values of each window
        power, size, factor = h, 1, BASE
        bits = k
        # take the binary digits of k from the lowest; ``power`` is the hash of ``size`` values
        while bits:
            if bits & 1:
                own = power[: len(h) - size + 1]
                out = own.copy() if out is None else own[: len(own) - done] * _power(done) + out[size : size + len(own) - done]
                done += size
            bits >>= 1
            if bits:
                power = power[: len(power) - size] * factor + power[size:]
                size, factor = size * 2, factor * factor
    return out[:n]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def planes(a: np.ndarray) -> bytes:
    """Bytes of numbers, highest bytes of all first: in ascending numbers those hardly differ, and shuffle compression finds them."""
    a = np.ascontiguousarray(a)
    return a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def from_planes(data, dtype) -> np.ndarray:
    d = np.dtype(dtype).newbyteorder(">")
    return np.frombuffer(data, np.uint8).reshape(d.itemsize, -1).T.copy().view(d).ravel().astype(dtype)


def pack(a: np.ndarray) -> bytes:
    """Planes, compressed with their number; nothing for no numbers."""
    return len(a).to_bytes(8, "little") + pa.compress(planes(a), codec="zstd", asbytes=True) if len(a) else b""


def unpack(data, dtype) -> np.ndarray:
    """Of a pyarrow scalar."""
    b = data.as_buffer() if data.is_valid else None
    if b is None or not b.size:
        return np.empty(0, dtype)
    n = int.from_bytes(b[:8].to_pybytes(), "little")
    return from_planes(pa.decompress(b[8:], decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd"), dtype)
