"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Rows go to shards of bounded size by the hash of their id, whatever the number of rows. A shard's graph is kept as flat neighbour
arrays, one per level, next to its vectors, as a row of a table. Nearness is the inner product; the graph is built on vectors
lengthened by one component that gives all the same norm, which turns the largest inner product into the smallest distance.
Equal vectors of a shard share a node. Building and searching work on many vectors at a time in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.session import stage

SHARD_ROWS = 8192
QUERY_GROUP = 16_384
LINKS = 16
EF_BUILD = 96
EF_SEARCH = 160
BATCH = 256


def _nearest_first(d: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(d, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes."""
    diff = x[ids] - q[:, None, :]
    return np.einsum("bmd,bmd->bm", diff, diff)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries together. Returns distances and nodes, nearest first; inf and -1 fill up."""
    b = len(q)
    seen = np.zeros((b, len(x)), bool)
    rows = np.arange(b)
    seen[rows, entry] = True
    ids = np.full((b, ef), -1, np.int64)
    d = np.full((b, ef), np.inf, np.float32)
    done = np.ones((b, ef), bool)
    ids[:, 0], d[:, 0], done[:, 0] = entry, _distances(x, entry[:, None], q)[:, 0], False
    active = rows
    while len(active):
        open_d = np.where(done[active], np.inf, d[active])
        at = open_d.argmin(axis=1)
        live = np.isfinite(open_d[np.arange(len(active)), at])
        active, at = active[live], at[live]
        if not len(active):
            break
        done[active, at] = True
        near = links[ids[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, 0)
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        nd = np.where(fresh, _distances(x, near, q[active]), np.inf)
        all_d = np.concatenate([d[active], nd], axis=1)
        all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        d[active], ids[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_d, all_i, all_done))
    return d, ids


def diverse(x: np.ndarray, own: np.ndarray, d: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates sorted by distance, those nearer to the node than to any candidate already kept; filled with the nearest others."""
    b, m = ids.shape
    kept = np.full((b, keep), -1, np.int64)
    count = np.zeros(b, np.int64)
    taken = np.zeros((b, m), bool)
    for j in range(m):
        c = ids[:, j]
        ok = (c >= 0) & (c != own) & (count < keep)
        if not ok.any():
            continue
        rows = np.flatnonzero(ok)
        diff = x[np.maximum(kept[rows], 0)] - x[c[rows]][:, None, :]
        apart = np.where(kept[rows] >= 0, np.einsum("bmd,bmd->bm", diff, diff), np.inf).min(axis=1)
        rows = rows[d[rows, j] < apart]
        kept[rows, count[rows]] = c[rows]
        count[rows] += 1
        taken[rows, j] = True
    for j in range(m):
        rows = np.flatnonzero((ids[:, j] >= 0) & (ids[:, j] != own) & ~taken[:, j] & (count < keep))
        kept[rows, count[rows]] = ids[rows, j]
        count[rows] += 1
    return kept


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Add the reverse of the new nodes' links; lists that overflow are chosen anew."""
    width = links.shape[1]
    src = np.repeat(new, width)
    dst = links[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, n = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(targets), n.max(initial=0)), -1, np.int64)
    extra[np.repeat(np.arange(len(targets)), n), np.arange(len(dst)) - np.repeat(first, n)] = src
    both = np.concatenate([links[targets], extra], axis=1)
    d = np.where(both >= 0, _distances(x, np.maximum(both, 0), x[targets]), np.inf)
    d, both = _nearest_first(d, both, both.shape[1])
    again = np.concatenate([np.zeros((len(both), 1), bool), (both[:, 1:] == both[:, :-1])], axis=1)
    both[again] = -1
    links[targets] = diverse(x, targets, d, both, width)


class Graph:
    """Levels of flat neighbour arrays over distinct vectors. Level 0 holds all nodes; the nodes of a higher level come first below."""

    def __init__(self, x: np.ndarray, sizes: list[int], levels: list[np.ndarray]):
        self.x, self.sizes, self.levels = x, sizes, levels

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
        """x: vectors in random order. The first n // links of a level's n nodes also make up the level above."""
        sizes = [len(x)]
        while sizes[-1] > 2 * links:
            sizes.append(sizes[-1] // links)
        levels: list[np.ndarray] = []
        for depth in range(len(sizes) - 1, -1, -1):
            n, width = sizes[depth], links * (2 if depth == 0 else 1)
            own = np.full((n, width), -1, np.int64)
            start = min(n, max(BATCH, sizes[depth + 1] if depth + 1 < len(sizes) else 0))
            for a in range(0, start, BATCH):  # the first nodes see all of one another
                rows = np.arange(a, min(a + BATCH, start))
                d = np.maximum((x[rows] ** 2).sum(1)[:, None] + (x[:start] ** 2).sum(1)[None] - 2 * x[rows] @ x[:start].T, 0)
                d[np.arange(len(rows)), rows] = np.inf
                d, ids = _nearest_first(d, np.broadcast_to(np.arange(start), d.shape), ef)
                own[rows] = diverse(x, rows, d, ids, width)
            if start:
                _link_back(x, own, np.arange(start))
            upper = cls(x, sizes[depth + 1 :], levels[::-1])
            done = start
            while done < n:
                rows = np.arange(done, min(n, done + BATCH))
                entry = upper.entry(x[rows])
                d, ids = beam(x[:done], own, x[rows], entry, ef)
                mates = np.broadcast_to(rows, (len(rows), len(rows)))
                md = _distances(x, mates, x[rows])
                md[np.arange(len(rows)), np.arange(len(rows))] = np.inf
                md, mates = _nearest_first(md, mates, ef)
                d, ids = _nearest_first(np.concatenate([d, md], axis=1), np.concatenate([ids, mates], axis=1), ef)
                own[rows] = diverse(x, rows, d, np.where(np.isfinite(d), ids, -1), width)
                _link_back(x, own, rows)
                done += len(rows)
            levels.append(own)
        return cls(x, sizes, levels[::-1])

    def entry(self, q: np.ndarray) -> np.ndarray:
        """The nearest node found by descending all of these levels greedily."""
        at = np.zeros(len(q), np.int64)
        for n, links in zip(self.sizes[::-1], self.levels[::-1], strict=True):
            at = beam(self.x[:n], links, q, at, 4)[1][:, 0]
        return at

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        upper = Graph(self.x, self.sizes[1:], self.levels[1:])
        return beam(self.x, self.levels[0], q, upper.entry(q), ef)[1]


_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("norm", pa.float64()), ("sizes", pa.list_(pa.int64())), ("widths", pa.list_(pa.int64())), ("neighbours", pa.list_(pa.int32())), ("holders", pa.list_(pa.int64())), ("holder_ends", pa.list_(pa.int64()))])
_INDEX_SQL = "dim int, shard int, vectors binary, norm double, sizes array<long>, widths array<long>, neighbours array<int>, holders array<long>, holder_ends array<long>"


def _lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _build(links: int, ef: int):
    def run(key, rows):
        dim, shard = (k.as_py() for k in key)
        ids = rows["vec_id"].to_numpy()
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["embedding"].chunks]).reshape(len(ids), dim) + 0.0  # -0 is 0
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, node = np.unique(x.view(np.dtype((np.void, 8 * dim))).ravel(), return_index=True, return_inverse=True)
        mixed = np.random.default_rng(shard).permutation(len(first))
        place = np.empty(len(first), np.int64)
        place[mixed] = np.arange(len(first))
        distinct, node = x[first[mixed]], place[node]
        pairs = np.unique(np.stack([node, ids], axis=1), axis=0)
        ends = np.searchsorted(pairs[:, 0], np.arange(len(distinct)), side="right")
        norm = float(np.sqrt((distinct**2).sum(1).max()))
        scale = norm or 1.0
        g = Graph.build(_lengthened(distinct / scale, 1.0), links, ef)
        flat = np.concatenate([level.ravel() for level in g.levels]).astype(np.int32)
        return pa.table([[dim], [shard], [distinct.tobytes()], [norm], [g.sizes], [[level.shape[1] for level in g.levels]], [flat], [pairs[:, 1]], [ends]], schema=_INDEX)

    return run


def _search(k: int, ef: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, index, queries):
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        row = index.slice(0, 1).to_pylist()[0]
        dim = row["dim"]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        flat, at, levels = np.array(row["neighbours"], np.int64), 0, []
        for n, width in zip(row["sizes"], row["widths"], strict=True):
            levels.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        scale = row["norm"] or 1.0
        g = Graph(_lengthened(x / scale, 1.0), row["sizes"], levels)
        holders, ends = np.array(row["holders"], np.int64), np.array(row["holder_ends"], np.int64)
        starts = np.r_[0, ends[:-1]]
        q = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in queries["embedding"].chunks]).reshape(-1, dim)
        ids, hashes = queries["query_id"].to_numpy(), queries["query_hash"].to_numpy()
        out = []
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            size = np.sqrt((part**2).sum(1, keepdims=True))
            found = g.search(np.concatenate([part / size, np.zeros((len(part), 1))], axis=1).astype(np.float32), min(ef, max(len(x), 1)))
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                score = (x[nodes] * part[i]).sum(axis=1)
                # of equal vectors only the k + 1 smallest ids can be among the k nearest
                n = np.minimum(ends[nodes] - starts[nodes], k + 1)
                near = holders[np.repeat(starts[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat(score, n)
                other = near != ids[a + i]
                near, score = near[other], score[other]
                best = np.lexsort((near, -score))[:k]
                out.append((np.full(len(best), ids[a + i]), np.full(len(best), hashes[a + i]), near[best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the rows that take part: not those without a vec_id, without a vector, with a zero vector, or
    with a component that is missing or not finite."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def build_index(embeddings: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """A row per shard with its vectors, flat neighbour arrays (all levels, lowest first), and the vec_ids that hold each vector. Every usable
    row is indexed. Written once. Vectors of different length are in different shards. An empty table gives no shard."""
    rows = usable(embeddings)
    shards = max(1, -(-rows.count() // shard_rows))
    return stage(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(_build(links, ef), _INDEX_SQL))


def search(index: DataFrame, embeddings: DataFrame, is_query: Column, k: int = 20, ef: int = EF_SEARCH, query_group: int = QUERY_GROUP) -> DataFrame:
    """The k nearest found of each usable row that ``is_query``: query_id, rank (from 1), vec_id, score (inner product of the vectors in double
    precision), nearest first, ties to the smaller vec_id. Rows with the query's vec_id are left out.

    Every query visits every shard of its length, in groups of bounded size; a shard answers with its k best, and those are merged. Rows that
    repeat a vec_id and its vector count once; a vec_id with two vectors is two queries and two candidates.
    """
    queries = usable(embeddings).where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_hash"), "embedding", "dim").dropDuplicates(["query_id", "query_hash"])
    groups = max(1, -(-queries.count() // query_group))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    sent = queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["dim", "shard", "group"]
    near = graphs.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_search(k, ef), "query_id long, query_hash long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
