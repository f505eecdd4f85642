"""N-gram Jaccard join: an R-tree of count vectors bounds the overlap of shingle sets before any two sets are compared.

The shingles of a document are hashed into a fixed number of groups, and the number in each group makes it a point. Two sets share at most
the sum, over the groups, of the smaller of their two counts; against a box of points, of the smaller of its count and the box's largest.
An R-tree of such boxes, packed from the points, finds for a set all points that could reach the threshold; the pairs that survive are
decided on the full sets.

One tree over a corpus would send every document through most of it, so trees are built in *buckets* outside of which no link can lie. Order
all shingles in any one way: two sets at the threshold share one of their first n - ceil(t * n) + 1 shingles. The order here puts frequent
shingles last, as far as one bounded table of hashed counts tells, so that a passage many documents share fills no bucket; the order decides
how much work there is, never what is found. Buckets with the same members are one.

Copies are not expanded into pairs. Equal sets are one node. In a bucket, members are first compared with one of them, then twice more with
another, which unites groups of copies; members that already are in one component need no comparing. Only what then still is apart
goes through the bucket's trees, in pages of bounded size, every page against every other whose sizes can match.

Before full sets are fetched for a pair, its odd sketches are compared: one bit a group, for more groups than shingles, that says whether the
group's number is odd. Shared shingles cancel in their XOR, so the bits left are at most the shingles that are in one set only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelake.session import owning, release, stage

from .common import lower_ascii_text, words_of
from .components import components
from .near_dups import PAIR_BATCH, _batches_of, _compare, _differing, _long, _short, shingles_of
from .odd import BRIEF_BITS, ODD_BITS, odd_fits, odd_may_link, odd_sketch, sizes_fit, total  # noqa: F401
from .rolling import WordHashes

SHINGLE = 5
THRESHOLD = 80
#: A set of n shingles has the power of two next below n / 4 of groups, within these: few enough shingles a group for the counts to tell sets apart.
GROUPS, MOST_GROUPS = 64, 4096
STARS = 3
LEAF = 32
FANOUT = 8
#: Rows that go to Python at once: they hold whole texts or sets.
BATCH_ROWS = 1_000
#: Points of one tree, and queries sent to it at once.
PAGE = 2048
#: The table of frequent shingles: counters (a power of two) and how many of them are kept.
COUNTER_BITS = 22
FREQUENT = 1 << 16
#: Bits of the map that says whose sets are needed. Where more rows are than it has bits it lets all of them through.
BITMAP_BITS = 23


class CountTree:
    """R-tree of count vectors, packed by splitting the points in halves along the coordinate that varies most."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.place = np.concatenate(_packed(x, np.arange(len(x)), leaf)) if len(x) else np.empty(0, np.int64)
        self.leaf, self.fanout = leaf, fanout
        high, least = x[self.place], x[self.place].sum(axis=1)
        self.levels, step = [(high, least)], leaf
        while len(high) > 1:  # from the points up: largest counts of each box, and its smallest set
            at = np.arange(0, len(high), step)
            high, least, step = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), fanout
            self.levels.append((high, least))

    def search(self, q: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all points whose overlap with the query may reach the threshold."""
        size = q.sum(axis=1)
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        if not len(self.place):
            return who[:0], node[:0]
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            fits = np.concatenate([may_link(q[w], high[n], size[w], least[n], threshold) for w, n in _chunks(who, node)]) if len(who) else np.empty(0, bool)
            who, node = who[fits], node[fits]
            if depth:
                width = self.leaf if depth == 1 else self.fanout
                node = (node[:, None] * width + np.arange(width)).ravel()
                who = np.repeat(who, width)
                real = node < len(self.levels[depth - 1][1])
                who, node = who[real], node[real]
        return who, self.place[node]


def _chunks(who: np.ndarray, node: np.ndarray, n: int = 1 << 14):
    for a in range(0, len(who), n):
        yield who[a : a + n], node[a : a + n]


def _packed(x: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Runs of at most ``leaf`` rows that are near one another; all but the last are full."""
    if len(rows) <= leaf:
        return [rows]
    half = (len(rows) // leaf + 1) // 2 * leaf
    axis = x[rows].var(axis=0).argmax()
    order = rows[np.argsort(x[rows, axis], kind="stable")]
    if half == len(rows):
        half -= leaf
    return _packed(x, order[:half], leaf) + _packed(x, order[half:], leaf)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: int) -> np.ndarray:
    """Can sets with these counts have 100 * both >= threshold * either? ``b`` may be the largest counts of a box and ``size_b`` its smallest size."""
    return np.minimum(a, b).sum(axis=1) * (100 + threshold) >= threshold * (size_a + size_b)


def counts_of(s: np.ndarray, least: int = GROUPS) -> np.ndarray:
    """The number of shingles in each group."""
    groups = min(max(least, 1 << max(0, (len(s) // 4).bit_length() - 1)), max(least, MOST_GROUPS))
    return np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups: group g of them is made of g, g + groups, ..."""
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def prefix_of(s: np.ndarray, late: np.ndarray | None, threshold: int) -> np.ndarray:
    """The first shingles of an ascending set, one of which every set at the threshold shares; ``late`` holds the counters' weights."""
    n = len(s)
    p = n - -(-n * threshold // 100) + 1 if n else 0
    if late is None or p == n:
        return s[:p]
    w = late[(s >> np.uint64(48 - COUNTER_BITS)).astype(np.int64)]
    return s[np.lexsort((s, w))[:p]] if w.any() else s[:p]


_SIGNED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("shingles", pa.binary())])


def _sets(k: int):
    def run(batches):
        from pyspark import TaskContext

        hashes, uid = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            sets = [shingles_of(words_of(lower_ascii_text(t.as_py() or "")), hashes, k) for t in batch["text"]]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [range(uid, uid + len(sets)), batch["doc_id"], [len(s) for s in sets], keys, [_short(s) for s in sets]]
            uid += len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)

    return run


def _count_hashes(batches):
    """Counters that stand out in a task's sets."""
    seen = np.zeros(1 << COUNTER_BITS, np.int64)
    total, held, size = 0, [], 0
    for batch in batches:
        for data in batch["shingles"]:
            held.append((_long(data.as_buffer()) >> np.uint64(48 - COUNTER_BITS)).astype(np.int32))
            size += len(held[-1])
            if size > 1 << 20:
                seen += np.bincount(np.concatenate(held), minlength=len(seen))
                total, held, size = total + size, [], 0
    if held:
        seen += np.bincount(np.concatenate(held), minlength=len(seen))
        total += size
    found = np.flatnonzero(seen > 4 + 4 * total / len(seen))
    if len(found) > FREQUENT:
        found = found[np.argpartition(seen[found], -FREQUENT)[-FREQUENT:]]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found])], names=["counter", "n"])


def _frequent(sets: DataFrame) -> np.ndarray | None:
    """The counters of frequent shingles, at most FREQUENT of them, with their counts over all sets."""
    rows = sets.select("shingles").mapInArrow(_count_hashes, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "counter").limit(FREQUENT).collect()
    return np.array([(r.counter, r.n) for r in rows], np.int64) if rows else None


def _prefixes(threshold: int, frequent):
    def run(batches):
        late = None
        if frequent is not None:
            late = np.zeros(1 << COUNTER_BITS, np.int64)
            late[frequent[:, 0]] = frequent[:, 1]
        for batch in batches:
            tokens = [prefix_of(_long(data.as_buffer()), late, threshold).astype(np.int64) for data in batch["shingles"]]
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(tokens, pa.list_(pa.int64()))], names=["uid", "tokens"])

    return run


def _bits(uids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the hashed numbers of some rows: it may let others through, never holds one back."""
    at = F.pmod(F.xxhash64("uid"), F.lit(1 << BITMAP_BITS))
    words = uids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(uid), {1 << BITMAP_BITS}) % 64 AS INT))")).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words:
        out[r.word] = r.bits
    return out


def _has(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch["at"].to_numpy()
    return batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))


def _only(bits: np.ndarray):
    """The rows that the bitmap has."""
    return lambda batches: (_has(bits, batch) for batch in batches)


def _decided(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The sizes of the intersection and union of each pair's (a, b) full sets. Written. Only sets that occur in a pair are moved."""
    pairs = stage(pairs)
    of = lambda c: near.select("uid", "at", "shingles").mapInArrow(_only(_bits(pairs.select(F.col(c).alias("uid")))), "uid long, at long, shingles binary").select(F.col("uid").alias(c), F.col("shingles").alias(f"set_{c}"))
    with _batches_of(pairs.sparkSession, PAIR_BATCH):
        return stage(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_compare, "a long, b long, both long, either long"))


def _near_sets(groups: int, bits: np.ndarray):
    """The sets of rows that the bitmap has, with their count vectors and odd sketches."""

    def run(batches):
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            batch = _has(bits, batch)
            sets = [_long(d.as_buffer()) for d in batch["shingles"]]
            odd = [odd_sketch(x) for x in sets]
            brief = [np.bitwise_xor.reduce(o.reshape(-1, BRIEF_BITS // 64)) for o in odd]
            columns = [pa.array([len(x) for x in sets], pa.int32()), pa.array([counts_of(x, groups) for x in sets], ints), pa.array(odd, longs), pa.array(brief, longs)]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["at"], batch["shingles"], *columns], names=["uid", "at", "shingles", "size", "counts", "odd", "brief"])

    return run


def _tree_join(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, points, queries):
        if not points.num_rows or not queries.num_rows:
            return schema.empty_table()
        counts = [[np.asarray(c) for c in t["counts"].to_numpy()] for t in (points, queries)]
        groups = min(len(c) for side in counts for c in side)  # sets of near sizes: most often the same number for all
        x, q = (np.stack([folded(c, groups) for c in side]) for side in counts)
        uid_x, uid_q, label_x, label_q = (t[c].to_numpy() for c in ("uid", "label") for t in (points, queries))
        tree, out = CountTree(x), []
        for at in range(0, len(q), 256):
            who, point = tree.search(q[at : at + 256], threshold)
            who = who + at
            apart = label_q[who] != label_x[point]
            a, b = uid_q[who[apart]], uid_x[point[apart]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        a, b = np.concatenate(out, axis=1)
        return pa.table([a, b], schema=schema)

    return run


def _fields_of(near: DataFrame, c: str, *fields: str) -> DataFrame:
    return near.select(F.col("uid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in fields])


def _bucket_pairs(rest: DataFrame, near: DataFrame, threshold: int, page: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components that may link, as far as the trees or, in a bucket that fits in one leaf, the
    brief odd sketches tell.

    ``rest``: bucket, uid, label, size (of the set), brief, many (members of the bucket), inside (in the component that members were last compared
    with). ``near``: uid, counts. Points are dealt into pages by class of size and by hash; queries, the members that are not inside, visit the pages of the neighbouring
    classes. A bucket that fits in one leaf needs no tree: its members are compared with that leaf.
    """
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("uid", "label", "size", "brief")]
    leaf = rest.where(F.col("many") <= LEAF)
    u, v = leaf.where(~F.col("inside")).select(F.col("bucket"), *side("a")), leaf.select(F.col("bucket").alias("bucket_b"), *side("b"))
    fits = sizes_fit(threshold) & odd_fits(_differing("brief_a", "brief_b", BRIEF_BITS), threshold)
    # decided in the join: most members of a bucket share little more than its shingle, and their pairs grow with the square of its size
    direct = u.join(v, (F.col("bucket") == F.col("bucket_b")) & (F.col("label_a") != F.col("label_b")) & fits).select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b"))
    rest = stage(rest.where(F.col("many") > LEAF).drop("brief").join(near.select("uid", "counts"), "uid"))
    # sizes at the threshold differ by at most this ratio, a hair wider than exact, so they are in the same or in neighbouring classes
    ratio = float(np.log(100 / threshold)) * (1 + 1e-9) if threshold < 100 else 1.0
    place = lambda n: F.floor(F.ln(n) / ratio)
    pages = F.ceil(F.col("many") / page).cast("int")
    own = F.pmod(F.xxhash64("uid"), pages).cast("int")
    every = F.sequence(F.lit(0), pages - 1)
    points = rest.select("bucket", "uid", "label", "counts", place(F.col("size")).alias("class"), own.alias("page"), F.explode(every).alias("part"))
    queries = rest.where(~F.col("inside")).select("bucket", "uid", "label", "counts", place(F.col("size")).alias("_c"), own.alias("part"), every.alias("_p"))
    queries = queries.withColumn("page", F.explode("_p")).withColumn("class", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1))).drop("_c", "_p")
    key = ["bucket", "class", "page", "part"]
    found = points.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_tree_join(threshold), "a long, b long")
    return direct.unionByName(found).distinct()


def _may_link(threshold: int):
    """:func:`may_link` of the columns counts_a, size_a and those of b; where the groups differ by more than twice, of the sizes alone."""
    most = F.coalesce(total("counts_a", "counts_b", lambda x, y: x + y, lambda x, y: F.least(x, y)), F.least("size_a", "size_b"))
    return most * (100 + threshold) >= threshold * (F.col("size_a") + F.col("size_b"))


def join_sets(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, groups: int = GROUPS, stars: int = STARS, page: int = PAGE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included).

    Linked are documents with 100 * |A and B| >= threshold * |A or B|, for a threshold of 1 to 100. A null text, or one without words, has the
    empty set and is linked with nothing. Rows that repeat a doc_id are each linked by their own text; a row without a doc_id takes no part and its
    component is null. An empty table gives no row. Only doc_id and text are read.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("a threshold lies in 1 to 100")
    with _batches_of(docs.sparkSession, BATCH_ROWS):
        return _join_sets(docs, shingle, threshold, groups, stars, page)


def _join_sets(docs: DataFrame, shingle: int, threshold: int, groups: int, stars: int, page: int) -> DataFrame:
    spark, own = docs.sparkSession, []
    with owning(own):
        signed = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sets(shingle), "uid long, doc_id long, n_shingles long, key binary, shingles binary"))
    is_node = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    rows = stage(signed.drop("shingles"))
    usable = signed.where(is_node)
    # equal sets are one node, named by the row of their smallest doc_id
    by_key = stage(rows.where(is_node).groupBy("key").agg(F.min(F.struct("doc_id", "uid")).alias("first")).select("key", "first.uid", "first.doc_id"))
    prefixes = usable.select("uid", "shingles").mapInArrow(_prefixes(threshold, _frequent(usable)), "uid long, tokens array<long>")
    postings = prefixes.join(by_key.select("uid"), "uid").select("uid", F.explode("tokens").alias("bucket"))
    whole = Window.partitionBy("bucket")
    shared = postings.withColumns({"many": F.count(F.lit(1)).over(whole), "low": F.min("uid").over(whole), "mix": F.bit_xor(F.xxhash64("uid")).over(whole)}).where("many > 1")
    shared = stage(shared)
    kept = shared.where("uid = low").groupBy("many", "low", "mix").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = stage(shared.join(kept, "bucket").select("bucket", "uid", "many"))
    # only documents that share a bucket are looked at from here on, and the table of all sets goes
    at = F.pmod(F.xxhash64("uid"), F.lit(1 << BITMAP_BITS)).alias("at")
    made = usable.select("uid", at, "shingles").mapInArrow(_near_sets(groups, _bits(members)), "uid long, at long, shingles binary, size int, counts array<int>, odd array<long>, brief array<long>")
    near = stage(made)
    release(spark, own)
    is_link = F.col("both") * 100 >= F.col("either") * threshold

    def likely(pairs: DataFrame, *fields: str) -> DataFrame:
        """Pairs that may link by their odd sketches; what else was asked for is there to judge them by."""
        of = lambda c: _fields_of(near, c, "size", "odd", *fields)
        return stage(pairs).join(of("a"), "a").join(of("b"), "b").where(odd_may_link(threshold))

    linked = spark.createDataFrame([], "node long, component long")
    tested = spark.createDataFrame([], "a long, b long")

    def with_links(linked: DataFrame, decided: DataFrame) -> DataFrame:
        links = linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(decided.where(is_link).select("a", "b"))
        return components(links)

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs.join(tested, (pairs["a"] == tested["a"]) & (pairs["b"] == tested["b"]), "left_anti").join(
            tested.select(F.col("b").alias("_a"), F.col("a").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")

    def apart(linked: DataFrame, k: int) -> DataFrame:
        """Members, with their component, of the buckets that hold several, and one of them to compare with."""
        rows = stage(members.join(linked.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid")).drop("component"))
        ends = rows.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.min_by(F.struct("uid", "label"), F.xxhash64("uid", F.lit(k))).alias("centre"))
        return stage(rows.join(stage(ends.where("_low != _high").select("bucket", "centre")), "bucket"))

    for k in range(stars):
        # each member is compared with one centre a turn: in the first with that of its largest bucket
        turn = F.when(F.lit(k == 0), -F.col("many")).otherwise(F.xxhash64("bucket", F.lit(k)))
        pairs = apart(linked, k).where(F.col("label") != F.col("centre.label")).groupBy(F.col("centre.uid").alias("a"), F.col("uid").alias("b")).agg(F.min(turn).alias("turn"))
        decided = _decided(likely(untested(pairs)).groupBy("b").agg(F.min_by("a", F.struct("turn", "a")).alias("a")).select("a", "b"), near)
        linked, tested = with_links(linked, decided), tested.unionByName(decided.select("a", "b"))
    rest = apart(linked, stars).withColumn("inside", F.col("label") == F.col("centre.label")).drop("centre").join(near.select("uid", "size", "brief"), "uid")
    pairs = likely(untested(_bucket_pairs(stage(rest), near, threshold, page)), "counts").where(_may_link(threshold)).select("a", "b")
    final = with_links(linked, _decided(pairs, near))

    # a component is named by its smallest doc_id
    named = stage(by_key.join(final.withColumnRenamed("node", "uid"), "uid", "left").select("key", "doc_id", F.coalesce("component", "uid").alias("component")))
    classes = stage(named.join(stage(named.groupBy("component").agg(F.min("doc_id").alias("component_id"))), "component").select("key", "component_id"))
    return rows.where(is_node).join(classes, "key").select("doc_id", "n_shingles", "component_id").unionByName(rows.where(~is_node).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([md5(array_to_string(list_slice(w, i, i + 4), ' ')) FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM d),
items AS (SELECT doc_id, unnest(s) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, least(a, b) AS r FROM two_way UNION SELECT two_way.a, reach.r FROM two_way JOIN reach ON two_way.b = reach.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) USING (doc_id)
"""
