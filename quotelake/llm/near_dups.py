"""Near-duplicate documents: MinHash bands for candidates, odd sketches to sift them, full shingle sets to confirm.

A document's set is its distinct word shingles. Its MinHash samples do two jobs. Four at a time they name buckets, and documents
linked at the threshold share one but for about one pair in 10**5. All of them together are folded into a small bitmap in which each
sample toggles one bit: where two sets agree on a sample the toggles cancel, so the population count of the XOR of two bitmaps
estimates how many samples differ, precisely so for similar sets. Pairs whose count is too high for the threshold, by a wide
margin, are not looked at further; all others are decided on the full sets.

Equal sets are one node from the start. No bucket is ever expanded into all its pairs: its members are first compared with its first
document only, and then with one more of that document's component. What is in one component needs no more comparing. Only
members still outside the first document's component are compared with the rest, and of those pairs only the ones that neither odd
sketches of the whole sets, a sure bound, nor the triangle inequality of the Jaccard distance (through the distances to the first
document, already known) rule out. Full sets are moved only for pairs that are still left.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quotelake.session import stage

from .common import lower_ascii_text, words_of
from .components import components
from .odd import odd_may_link, odd_sketch, sizes_fit
from .rolling import WordHashes, window_hashes
from .sieve import marked, repeats, without

SHINGLE = 5
THRESHOLD = 75
BANDS = 32
ROWS = 4
SKETCH_BITS = 512
#: Samples that differ at the threshold toggle about 57 bits of 512, with a standard deviation of 8.6; this is 4.5 of them more.
MOST_BITS = 95
PAIR_BATCH = 500
BLOCK = 1 << 18

_SIGNED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("shingles", pa.binary())])
_SIGNED_SQL = "uid long, doc_id long, n_shingles long, key binary, bands array<long>, sketch array<long>, shingles binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles_of(words: list[str], hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The set as ascending 64-bit hashes; fewer than k words are one shingle, none are none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(h) >= k:
        return np.unique(_mixed(window_hashes(h, k)))
    return _mixed(window_hashes(h, len(h)) + np.uint64(len(h)))


def _short(x: np.ndarray) -> bytes:
    """Ascending hashes, 48 bits of each."""
    return (x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view("<u8").ravel()


def _signatures(sets: list[np.ndarray], bands: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band values and odd sketches (as 64-bit words) of non-empty sets."""
    k = bands * rows
    rng = np.random.default_rng(7)
    mult, plus = rng.integers(0, 1 << 62, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, k, np.uint64)
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    x = np.concatenate(sets)
    least = np.empty((len(sets), k), np.uint64)
    for i in range(k):
        least[:, i] = np.minimum.reduceat(x * mult[i] + plus[i], starts)
    at = np.arange(k, dtype=np.uint64)
    named = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        named = _mixed(named * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows] + np.uint64(r))
    named = _mixed(named + np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    bit = (_mixed(least + at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(bits)
    counts = np.zeros((len(sets), bits), np.uint8)
    np.add.at(counts, (np.repeat(np.arange(len(sets)), k), bit.astype(np.int64).ravel()), 1)
    return named.view(np.int64), np.packbits(counts & 1, axis=1).view(np.int64)


def _sign(k: int, bands: int, rows: int, bits: int, carry: bool):
    def run(batches):
        from pyspark import TaskContext

        hashes, uid = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            held, size, done = [], 0, 0

            def close(held, done):
                out = _signed(uid, held, bands, rows, bits)
                return out.append_column("row", batch["row"].slice(done, len(held))) if carry else out

            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                s = shingles_of(words_of(lower_ascii_text(text.as_py() or "")), hashes, k)
                held.append((doc_id, s))
                size += len(s)
                if size >= BLOCK:
                    yield close(held, done)
                    uid, done, held, size = uid + len(held), done + len(held), [], 0
            if held:
                yield close(held, done)
                uid += len(held)

    return run


def _signed(uid, held, bands, rows, bits) -> pa.RecordBatch:
    full = [i for i, (_, s) in enumerate(held) if len(s)]
    named: list = [None] * len(held)
    sketches: list = [None] * len(held)
    if full:
        b, o = _signatures([held[i][1] for i in full], bands, rows, bits)
        for j, i in enumerate(full):
            named[i], sketches[i] = b[j], o[j]
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for _, s in held]
    columns = [range(uid, uid + len(held)), [d for d, _ in held], [len(s) for _, s in held], keys, named, sketches, [_short(s) for _, s in held]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


@contextmanager
def _batches_of(spark, n: int):
    """Rows with two full sets go to Python few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _compare(batches):
    for batch in batches:
        shared = []
        for a, b in zip(batch["set_a"], batch["set_b"], strict=True):
            x, y = _long(a.as_buffer()), _long(b.as_buffer())
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared.append((int((y[at] == x).sum()), len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array([s for s, _ in shared], pa.int64()), pa.array([t - s for s, t in shared], pa.int64())], names=["a", "b", "both", "either"])


def _odd_sketches(batches):
    """Sizes and odd sketches of full sets."""
    for batch in batches:
        sets = [_long(d.as_buffer()) for d in batch["shingles"]]
        yield pa.RecordBatch.from_arrays([batch["uid"], pa.array([len(x) for x in sets], pa.int32()), pa.array([odd_sketch(x) for x in sets], pa.list_(pa.int64()))], names=["uid", "size", "odd"])


def _sets_of(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """uid and shingles of the rows with these numbers, and of few others: no set is shuffled for that."""
    return marked(sets.select("uid", "shingles"), numbers).where("_maybe").select("uid", "shingles")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sizes of the intersection and union of each distinct pair's full sets. Written. Only sets that occur in a pair are moved."""
    pairs = stage(pairs)
    of = lambda c: _sets_of(sets, pairs.select(F.col(c).alias("uid"))).select(F.col("uid").alias(c), F.col("shingles").alias(f"set_{c}"))
    with _batches_of(pairs.sparkSession, PAIR_BATCH):
        return stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_compare, "a long, b long, both long, either long"))


def _differing(x: str, y: str, bits: int):
    """Population count of the XOR of two sketches."""
    words = F.lit(0)
    for i in range(bits // 64):
        words = words + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return words


def _is_node():
    return F.col("key").isNotNull() & F.col("doc_id").isNotNull()


def _classes(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, most_bits: int = MOST_BITS, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with their numbers (uid) and the keys of their sets, written, and per key its component_id and the component's first row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    kinds = StructType([*StructType.fromDDL(_SIGNED_SQL), *([read.schema["row"]] if carry else [])])
    signed = stage(read.mapInArrow(_sign(shingle, bands, rows, bits, carry), kinds))
    usable = signed.where(_is_node())
    # equal sets are one node, named by the row of their smallest doc_id
    by_key = stage(usable.groupBy("key").agg(F.min(F.struct("doc_id", "uid")).alias("first")).select("key", "first.uid", "first.doc_id"))
    placed = stage(without(usable.select("uid", "bands"), stage(repeats(usable, by_key))).select("uid", F.explode("bands").alias("bucket")))
    # two numbers a bucket: almost every bucket has one member, so these rows are as many as all members
    centres = stage(placed.groupBy("bucket").agg(F.min("uid").alias("centre"), F.count("*").alias("size")).where("size > 1"))
    members = stage(placed.join(centres, "bucket").select("bucket", "uid", "centre", "size"))
    # only documents that share a bucket are looked at from here on, by their sketches before their sets
    brief = stage(marked(usable.select("uid", F.col("n_shingles").alias("size"), "sketch"), members.select("uid")).where("_maybe").drop("_maybe"))
    sets = stage(_sets_of(usable, members.select("uid")))  # read often, so without the sets of all others
    is_link = F.col("both") * 100 >= F.col("either") * threshold
    fields = lambda df, c, x: df.select(F.col("uid").alias(c), F.col("size").alias(f"size_{c}"), F.col(x).alias(f"{x}_{c}"))

    stars = members.where("uid != centre").select(F.col("centre").alias("a"), F.col("uid").alias("b")).distinct()
    stars = stars.join(fields(brief, "a", "sketch"), "a").join(fields(brief, "b", "sketch"), "b").where(sizes_fit(threshold) & (_differing("sketch_a", "sketch_b", bits) <= most_bits))
    stars = _confirm(stars.select("a", "b"), sets)
    linked = components(stars.where(is_link).select("a", "b"))

    def unsettled(linked: DataFrame) -> DataFrame:
        """Members, with their component, of buckets of three and more that hold several."""
        named = stage(members.where("size > 2").join(linked.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid")).drop("component", "size"))
        several = named.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("uid") == F.col("centre"), F.col("label"))).alias("centre_label"))
        return stage(named.join(stage(several.where("low != high").select("bucket", "centre_label")), "bucket"))

    open_ = unsettled(linked)
    with _batches_of(docs.sparkSession, PAIR_BATCH):
        odd = stage(_sets_of(sets, open_.select("uid")).mapInArrow(_odd_sketches, "uid long, size int, odd array<long>"))

    # a second star, around any other document of the centre's component
    inside = F.col("label") == F.col("centre_label")
    second = stage(open_.where(inside & (F.col("uid") != F.col("centre"))).groupBy("bucket").agg(F.min_by("uid", F.xxhash64("uid")).alias("b")))
    again = open_.where(~inside).select("bucket", F.col("uid").alias("a")).join(second, "bucket").select("a", "b").distinct()
    again = _confirm(again.join(fields(odd, "a", "odd"), "a").join(fields(odd, "b", "odd"), "b").where(odd_may_link(threshold)).select("a", "b"), sets)
    star_links = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = components(star_links.unionByName(again.where(is_link).select("a", "b")))

    away = stars.select(F.col("a").alias("centre"), F.col("b").alias("uid"), (1 - F.col("both") / F.col("either")).alias("away"))
    rest = (
        unsettled(linked).join(away, ["centre", "uid"], "left")
        .withColumn("away", F.when(F.col("uid") == F.col("centre"), 0.0).otherwise(F.col("away")))
        .select("bucket", "uid", "label", "centre_label", "away").join(odd, "uid"))
    rest = stage(rest)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("uid", "label", "away", "size", "odd")]
    u = rest.where("label != centre_label").select("bucket", *side("a"))
    v = rest.select(F.col("bucket").alias("bucket_b"), *side("b"))
    apart = 1 - threshold / 100 + 1e-9
    pair = (F.col("label_a") != F.col("label_b")) & F.coalesce(F.abs(F.col("away_a") - F.col("away_b")) <= apart, F.lit(True)) & odd_may_link(threshold)
    cross = u.join(v, (F.col("bucket") == F.col("bucket_b")) & pair).select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")).distinct()
    more = _confirm(cross, sets).where(is_link).select("a", "b")
    final = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # a component is named by its smallest doc_id
    label = F.coalesce("component", "uid")
    named = by_key.join(final.withColumnRenamed("node", "uid"), "uid", "left").select("key", "doc_id", "uid", label.alias("component"))
    named = stage(named)
    smallest = named.groupBy("component").agg(F.min(F.struct("doc_id", "uid")).alias("_f")).select("component", F.col("_f.doc_id").alias("component_id"), F.col("_f.uid").alias("_first"))
    classes = stage(named.join(stage(smallest), "component").select("key", "component_id", "_first"))
    return signed, classes


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, most_bits: int = MOST_BITS, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, its own included), kept
    (doc_id = component_id) and set_key (equal for equal sets).

    Linked are documents with 100 * |A and B| >= threshold * |A or B|. A null text, or one without words, has the empty set and is linked with
    nothing. Rows that repeat a doc_id are each linked by their own text; a row without a doc_id takes no part: its component is null and it is kept. Only
    doc_id and text are read.

    With ``carry`` each row also has the whole input ``row``, and ``first``: true for exactly one row of a component, the first found of its smallest
    doc_id, and for all rows that are linked with nothing.
    """
    signed, classes = _classes(docs, shingle, threshold, bands, rows, bits, most_bits, carry)
    own = signed.select("doc_id", "n_shingles", "key", "uid", *(["row"] if carry else []))
    is_node = _is_node()
    out = ["doc_id", "n_shingles", "component_id", "set_key", *(["row", "first"] if carry else [])]
    together = own.where(is_node).join(classes, "key").withColumn("set_key", F.col("key")).withColumn("first", F.col("uid") == F.col("_first")).select(*out)
    alone = own.where(~is_node).withColumn("component_id", F.col("doc_id")).withColumn("set_key", F.col("key")).withColumn("first", F.lit(True)).select(*out)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return together.unionByName(alone).withColumn("kept", kept).select("doc_id", "n_shingles", "component_id", "kept", *out[3:])


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id, and all rows without one; the same columns.

    Rows are told apart even where they share a doc_id: of equal or similar texts under one id one stays, different texts under one id all stay, each
    judged by its own text. Null texts, texts without words, and rows without a doc_id stay.
    """
    signed, classes = _classes(docs, carry=True)
    # whole rows stay where they are unless they may be copies
    copies = stage(signed.where(_is_node()).select("key", "uid").join(classes, "key").where("uid != _first").select("uid"))
    rows = marked(signed.select("uid", "row"), copies)
    return rows.where(~F.col("_maybe")).select("row.*").unionByName(rows.where("_maybe").join(copies, "uid", "left_anti").select("row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([md5(array_to_string(list_slice(w, i, i + 4), ' ')) FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END AS s FROM d),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, least(a, b) AS r FROM two_way UNION SELECT two_way.a, reach.r FROM two_way JOIN reach ON two_way.b = reach.doc_id),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(r, doc_id)) AS kept
FROM sizes LEFT JOIN least_of USING (doc_id)
"""
