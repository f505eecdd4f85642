"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are learned from: a label 0 is never used as a negative. With pi the share of
toxic text, the risk of a classifier is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): what the unlabelled text costs as negatives, less
what its toxic part would cost, never below zero, so a flexible model cannot win by calling every toxic example negative.

Features of a text are the distinct words and the beginnings of longer words, hashed to 32 bits. Several linear classifiers, each
on its own share of the unlabelled sample, first choose the features that toxic text has far more often than unlabelled text and
then fit non-negative weights to them by Adam on that risk. A document's score is the mean of their probabilities.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder


@dataclass(frozen=True)
class Settings:
    """``max_positive`` and ``max_unlabelled`` bound the sample that is learned from (expected numbers of documents); all documents
    are scored. ``prior`` is the share of toxic text; None: the share of label 1 among all labelled rows of the learning folds."""

    max_positive: int = 6_000
    max_unlabelled: int = 20_000
    members: int = 4
    prior: float | None = None
    min_lift: float = 3.0
    min_z: float = 5.0
    min_count: int = 3
    max_features: int = 4_000
    steps: int = 1_500
    rate: float = 0.05
    decay: float = 1e-5
    batch: int = 512


STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
#: Features go to a member as 32-bit numbers, moved by this so that their order stays.
SHIFT = 1 << 31
#: Tokens whose features a task remembers: bounds its memory.
KEPT = 150_000


class _Features(dict):
    """Token between white space -> hashes of its words and their beginnings."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        found: set[int] = set()
        for word in _WORD.findall(token):
            found.add(zlib.crc32(word.encode()))
            found.update(zlib.crc32(f"{word[:k]}*".encode()) for k in STEMS if len(word) > k)
        out = tuple(found)
        if len(self) < KEPT and len(token) < 64:
            self[token] = out
        return out


def features(text: str | None, cache: _Features) -> np.ndarray:
    """The distinct features of a whole text, ascending."""
    found: set[int] = set()
    for token in set((text or "").lower().split()):
        found.update(cache[token])
    return np.sort(np.fromiter(found, np.int64, len(found)))


def choose(toxic: list[np.ndarray], other: list[np.ndarray], s: Settings) -> np.ndarray:
    """Features that toxic documents hold clearly more often than unlabelled ones, ascending."""
    f, a = np.unique(np.concatenate(toxic), return_counts=True)
    g, b = np.unique(np.concatenate(other), return_counts=True)
    if not len(f):
        return f
    at = np.minimum(np.searchsorted(g, f), max(len(g) - 1, 0))
    b = np.where(g[at] == f, b[at], 0) if len(g) else np.zeros(len(f))
    p, u = a / len(toxic), (b + 0.5) / len(other)
    pool = (a + b + 0.5) / (len(toxic) + len(other) + 1)
    z = (p - u) / np.sqrt(pool * (1 - pool) * (1 / len(toxic) + 1 / len(other)))
    good = np.flatnonzero((a >= s.min_count) & (p >= s.min_lift * u) & (z >= s.min_z))
    return np.sort(f[good[np.argsort(-z[good], kind="stable")][: s.max_features]])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(toxic: list[np.ndarray], other: list[np.ndarray], prior: float, s: Settings, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights, and the bias, by Adam on the non-negative risk with logistic loss."""
    chosen = choose(toxic, other, s)
    n = len(chosen)
    own = lambda f: np.searchsorted(chosen, np.intersect1d(f, chosen, assume_unique=True))
    toxic, other = [own(f) for f in toxic], [own(f) for f in other]
    rng = np.random.default_rng(seed)
    w, mean, square = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = -1.0
    k = max(1, s.batch // 2)
    for t in range(1, s.steps + 1):
        docs = [toxic[i] for i in rng.integers(0, len(toxic), k)] + [other[i] for i in rng.integers(0, len(other), s.batch)]
        at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        idx = np.concatenate(docs).astype(np.int64)
        x = np.bincount(at, w[idx], len(docs)) + w[n]
        slope = np.zeros(len(docs))
        if np.logaddexp(0, x[k:]).mean() >= prior * np.logaddexp(0, x[:k]).mean():
            slope[:k] = -prior / k  # of pi * (loss as positive - loss as negative)
            slope[k:] = _sigmoid(x[k:]) / s.batch
        else:
            slope[:k] = -prior * _sigmoid(-x[:k]) / k
        grad = np.bincount(idx, slope[at], n + 1)
        grad[n] = slope.sum()
        grad[:n] += s.decay * w[:n]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= s.rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-6)
        np.maximum(w[:n], 0, out=w[:n])
    return chosen, w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), fold: int = 5, held: int = 0) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Train the members in Spark tasks and return them; at most ``members * max_features`` weights come to the driver.

    Rows whose crc32(doc_id) modulo ``fold`` is ``held`` teach nothing, neither as toxic nor as unlabelled text; nor do rows without
    a doc_id. Without a toxic label to learn from there is no member.
    """
    learns = fold_remainder(F.col("doc_id"), fold) != held
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learns & F.col("toxic").isNotNull())
    n, toxic = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return []
    prior = s.prior if s.prior is not None else min(0.99, toxic / n)
    total = docs.select("doc_id").where(learns).count()
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sampled = (
        marked.where((F.col("toxic") == 1) & (draw(1) < s.max_positive / toxic)).select("doc_id", F.lit(1).alias("kind")).distinct()
        .unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learns & (draw(2) < s.max_unlabelled / max(total, 1))).select("doc_id", F.lit(0).alias("kind")))
    )
    # at most max_positive + max_unlabelled ids, as expected numbers: small enough to send to every task
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sampled), "doc_id")
    members = F.when(F.col("kind") == 1, F.sequence(F.lit(0), F.lit(s.members - 1))).otherwise(F.array(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(s.members)).cast("int")))
    seen = picked.mapInArrow(_extract, "doc_id long, kind int, found array<int>").select("doc_id", "kind", "found", F.explode(members).alias("member"))

    def one(key, group):
        # a member's documents are its task's memory: their features are neither sorted nor copied, only looked at in order
        order = pa.compute.sort_indices(group.select(["kind", "doc_id"]), sort_keys=[("kind", "ascending"), ("doc_id", "ascending")]).to_numpy()
        kinds = group["kind"].to_numpy()[order]
        rows = [r for chunk in group["found"].chunks for r in _views(chunk)]
        rows = [rows[i] for i in order]
        other, pos = [r for r, k in zip(rows, kinds, strict=True) if k == 0], [r for r, k in zip(rows, kinds, strict=True) if k == 1]
        if not pos or not other:
            return made.empty_table()
        f, w, bias = fit(pos, other, prior, s, key[0].as_py())
        return pa.table({"member": [key[0].as_py()], "features": [f.astype(np.int64) + SHIFT], "weights": [w], "bias": [bias]}, schema=made)

    made = pa.schema([("member", pa.int32()), ("features", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())])
    rows = seen.groupBy("member").applyInArrow(one, "member int, features array<long>, weights array<double>, bias double").collect()
    return [(np.array(r.features, np.int64), np.array(r.weights), r.bias) for r in sorted(rows, key=lambda r: r.member)]


def _views(lists: pa.ListArray) -> list[np.ndarray]:
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _extract(batches):
    cache = _Features()
    for batch in batches:
        found = [(features(t.as_py(), cache) - SHIFT).astype(np.int32) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["kind"].cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "kind", "found"])


class _Effects(dict):
    """Token -> the chosen features in it; most tokens have none."""

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self.chosen, self.all = chosen, _Features()

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = tuple(self.chosen[f] for f in _Features.__missing__(self.all, token) if f in self.chosen)
        self.all.clear()
        if len(self) < KEPT and len(token) < 64:
            self[token] = out
        return out


def score(docs: DataFrame, members: list[tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """docs with all their columns in a struct ``row`` and ``score``, the mean probability over members of the whole text.

    A null text scores as an empty one. Without members every score is 0.
    """
    every = np.unique(np.concatenate([f for f, _, _ in members])) if members else np.empty(0, np.int64)
    weights = np.zeros((len(every), len(members)))
    for m, (f, w, _) in enumerate(members):
        weights[np.searchsorted(every, f), m] = w
    bias = np.array([b for _, _, b in members])
    chosen = {int(f): i for i, f in enumerate(every)}

    def run(batches):
        effects = _Effects(chosen)
        for batch in batches:
            out = []
            for text in batch["row"].field("text"):
                own: set[int] = set()
                for hit in map(effects.__getitem__, set((text.as_py() or "").lower().split())):
                    if hit:
                        own.update(hit)
                out.append(float(_sigmoid(weights[sorted(own)].sum(axis=0) + bias).mean()) if members else 0.0)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.float64())], schema=pa.schema([batch.schema.field("row"), ("score", pa.float64())]))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """docs whose score is below the threshold, with the same columns."""
    return score(docs, train(docs, labels, s)).where(F.col("score") < threshold).select("row.*")
