"""Embedding whitening by shifted CholeskyQR.

The centred vectors are a tall matrix A, spread over the tasks. One pass adds up the Gram matrix of A's rows; its Cholesky factor R1,
taken with a small shift so that it exists however ill-conditioned A is, gives Q1 = A R1^-1, which is nearly orthonormal. Further
passes do the same to Q1, Q2, ...: every task solves its centred rows through the triangular factors found so far and sends one partial
Gram matrix. The factors compose to R = ... R3 R2 R1, with A = Q R. What the last pass finds for Q (the identity, but for directions in which
the vectors do not vary) completes R, and the singular values and right singular vectors of that small matrix are the standard
deviations and components of A. The covariance itself, whose condition number is that of A squared, is never decomposed.

Only d x d matrices reach the driver. Sums, counts and deviations are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.session import stage

COMPONENTS = 4
SCALE = 256
PASSES = 6
#: Passes end when the columns are orthonormal to this.
ORTHONORMAL = 1e-13
#: Directions whose share of the variance is below this do not vary.
FLAT = 1e-13
_LONG = 1 << 62


def entries(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (floor(scale * entry), longs) and dim of the rows whose vector is there, is not empty, and has finite entries only."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", fine) & (F.size("embedding") > 0))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("x"), F.size("embedding").alias("dim"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact(x: np.ndarray, rows: int) -> np.ndarray:
    """x as integers in which sums of so many rows cannot overflow."""
    return x if not len(x) or int(np.abs(x.astype(np.float64)).max()) < _LONG // max(rows, 1) else x.astype(object)


def _sums(dim: int):
    def run(batches):
        total, n = np.zeros(dim, object), 0
        for batch in batches:
            x = _matrix(batch["x"], dim)
            total, n = total + _exact(x, len(x)).sum(axis=0).astype(object), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(s) for s in total]), pa.array([n] * dim, pa.int64())], names=["i", "s", "n"])

    return run


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ..., by solves with the triangular factors."""
    for r in factors:
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _gram(dim: int, mean: np.ndarray, factors: list[np.ndarray]):
    upper = np.triu_indices(dim)

    def run(batches):
        total = None
        for batch in batches:
            q = _solved(_matrix(batch["x"], dim).astype(np.float64) - mean, factors)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    return run


class Whitening:
    """A fit: n distinct vectors, their sums, and the components, numbered by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float, passes: int):
        self.n, self.sums, self.components, self.values, self.trace, self.passes = n, sums, components, values, trace, passes
        self.mean = np.array([s / n for s in sums])
        self.identity_error = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.mean) @ self.components.T / np.sqrt(self.values)


def fit(distinct: DataFrame, dim: int, k: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """The whitening of a written table of distinct vectors ``x`` of one length; None where it is empty.

    Directions in which the vectors do not vary are no components, so there may be fewer than k of them, down to none for one vector.
    """
    rows = distinct.select("x")
    found = rows.mapInArrow(_sums(dim), "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    if not found:
        return None
    n, sums = found[0].n, [int(r.s) for r in sorted(found, key=lambda r: r.i)]
    mean = np.array([s / n for s in sums])

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((dim, dim))
        for r in rows.mapInArrow(_gram(dim, mean, factors), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r.i, r.j] = out[r.j, r.i] = r.v
        return out

    factors: list[np.ndarray] = []
    unit = np.finfo(np.float64).eps / 2
    g = gram(factors)
    trace = float(np.trace(g)) / n
    if trace == 0:
        return Whitening(n, sums, np.empty((0, dim)), np.empty(0), 0.0, 1)
    for _ in range(passes):
        norm = float(np.linalg.norm(g, 2))
        shift = 11 * (n * dim + dim * (dim + 1)) * unit * norm if not factors else 0.0
        while True:
            try:
                r = np.linalg.cholesky(g + shift * np.eye(dim)).T
                break
            except np.linalg.LinAlgError:  # flat directions stay flat in every pass
                shift = max(shift * 10, dim * unit * norm)
        factors.append(r)
        before, g = g, gram(factors)
        # orthonormal, or a projection onto the directions that vary: its eigenvalues are 1 and 0
        e = np.linalg.eigvalsh(g)
        if np.minimum(np.abs(e - 1), np.abs(e)).max() < ORTHONORMAL * dim or (len(factors) > 2 and np.abs(g - before).max() < ORTHONORMAL):
            break
    r = np.eye(dim)
    for f in factors:
        r = f @ r
    e, v = np.linalg.eigh(g)
    r = (v * np.sqrt(np.maximum(e, 0))) @ v.T @ r
    _, sigma, vt = np.linalg.svd(r)
    values = sigma**2 / n
    keep = min(k, int((values > FLAT * trace).sum()))
    out = Whitening(n, sums, vt[:keep], values[:keep], trace, len(factors) + 1)
    if keep:
        out.identity_error = _identity_error(rows, out)
    return out


def _identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured in one more pass."""
    k = len(w.values)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = np.column_stack([w.project(_matrix(batch["x"], w.dim)), np.ones(batch.num_rows)])
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    total = np.zeros((k + 1) ** 2)
    for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r.v
    total = total.reshape(k + 1, k + 1) / w.n
    return float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[:k, k]) - np.eye(k)).max())


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_SQL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where a long cannot hold it."""
    largest = (w.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(abs(s) for s in w.sums)) ** 2 * w.dim
    if largest < _LONG:
        return (((w.n * x - np.array(w.sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((w.n * x.astype(object) - np.array(w.sums, object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def _apply(w: Whitening):
    k = len(w.values)

    def run(batches):
        for batch in batches:
            x = _matrix(batch["x"], w.dim)
            m, dev = len(x), _deviations(x, w)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n), pa.int64()), pa.array([dev[i] for i in at], pa.int64()),
                pa.array(w.project(x).ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error))], schema=_OUT)

    return run


def whiten(embeddings: DataFrame, k: int = COMPONENTS, scale: int = SCALE, passes: int = PASSES) -> DataFrame:
    """For each row and component up to ``k``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped; zero vectors stay. The fit takes each distinct
    vector of integers once, so copies, however many, weigh as one; every row is whitened, repeated ones too, also without a vec_id. Vectors of
    another length are fitted among themselves. Where the vectors vary in fewer than k directions only those are components; a single
    distinct vector has none, and its rows are not returned. A deviation beyond 64 bits is null. An empty table gives no row. Only vec_id and
    embedding are read.
    """
    rows = entries(embeddings, scale)
    distinct = stage(rows.groupBy("dim", "x").agg(F.lit(1).alias("one")).select("dim", "x"))
    out = embeddings.sparkSession.createDataFrame([], _OUT_SQL)
    for dim in sorted(r.dim for r in distinct.select("dim").distinct().collect()):
        w = fit(distinct.where(F.col("dim") == dim), dim, k, passes)
        if w is not None and len(w.values):
            out = out.unionByName(rows.where(F.col("dim") == dim).select("vec_id", "x").mapInArrow(_apply(w), _OUT_SQL))
    return out
