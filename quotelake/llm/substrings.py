"""Substring de-duplication by Rabin-Karp hashes of every window of words.

Each block of documents hashes all its windows. A hash is sent, with the document and place of its first holder in the block, to the
part that owns its range; the part counts the holders and knows the earliest. What is not the earliest goes back to its document,
where repeated windows merge into maximal removal intervals. Numbers travel as packed arrays, a row per block and part. A passage
that all documents share costs a part one entry per block, however often the block has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of
from .rolling import WordHashes, pack, unpack, window_hashes

WINDOW = 20
BLOCK_WORDS = 1 << 20
#: Bytes of text that one part answers for.
PART_BYTES = 16 << 20
_FIRST = -(1 << 63)
#: Parts of an id and their multipliers, chosen so that Spark and numpy mix it alike without overflow.
LOW, HIGH, MIX_LOW, MIX_HIGH = (1 << 24) - 1, (1 << 40) - 1, 0x9E3779B1, 0x5BD1E9

_REQUEST = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("holders", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary()), ("texts", pa.binary()), ("known", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("texts", pa.binary()), ("starts", pa.binary())])


def _text_hash(text: str) -> int:
    """Tells rows apart that share a doc_id."""
    return xxhash.xxh32_intdigest(text)


def _bucket(ids: np.ndarray, parts: int) -> np.ndarray:
    """Where the documents of these ids gather."""
    u = ids.astype(np.int64).view(np.uint64)
    mixed = (u & np.uint64(LOW)) * np.uint64(MIX_LOW) + ((u >> np.uint64(24)) & np.uint64(HIGH)) * np.uint64(MIX_HIGH)
    return ((mixed >> np.uint64(17)) % np.uint64(parts)).astype(np.int32)


class _Block:
    """Windows of some documents."""

    def __init__(self, window: int, parts: int, hashes: WordHashes):
        self.window, self.parts, self.hashes = window, parts, hashes
        self.docs: list[tuple[int, int, np.ndarray]] = []
        self.words = 0

    def add(self, doc_id: int, text: str) -> None:
        words = words_of(text)
        if len(words) >= self.window:
            self.docs.append((doc_id, _text_hash(text), window_hashes(self.hashes.of(words), self.window)))
            self.words += len(words)

    def requests(self):
        """Per part: the earliest holders of each hash here. Windows that another document here has earlier are ``known`` to be repeats;
        repeats inside a document are left to it."""
        if not self.docs:
            return
        self.docs.sort(key=lambda d: d[:2])
        ids, texts = np.array([d[0] for d in self.docs], np.int64), np.array([d[1] for d in self.docs], np.uint32)
        counts = np.array([len(d[2]) for d in self.docs])
        h = np.concatenate([d[2] for d in self.docs])
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        start = (np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint32)
        order = np.argsort(h, kind="stable")  # then by document and place
        h, doc, start = h[order], doc[order], start[order]
        new_hash = np.r_[True, h[1:] != h[:-1]]
        own = new_hash | np.r_[True, doc[1:] != doc[:-1]]
        group = np.cumsum(new_hash) - 1
        earliest = ids[doc[np.flatnonzero(new_hash)]][group]
        later = own & (ids[doc] > earliest)
        sent = own & ~later
        k_doc, k_start = doc[later], start[later]
        known_part = _bucket(ids, self.parts)[k_doc]
        by = np.argsort(known_part, kind="stable")
        k_doc, k_start, known_part = k_doc[by], k_start[by], known_part[by]
        h, doc, start = h[sent], doc[sent], start[sent]
        part = ((h >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        edges, k_edges = np.searchsorted(part, np.arange(self.parts + 1)), np.searchsorted(known_part, np.arange(self.parts + 1))
        for p in range(self.parts):
            s, k = slice(edges[p], edges[p + 1]), slice(k_edges[p], k_edges[p + 1])
            if s.stop == s.start and k.stop == k.start:
                continue
            here, at = np.unique(np.concatenate([doc[s], k_doc[k]]), return_inverse=True)
            n = s.stop - s.start
            yield (p, pack(h[s]), pack(at[:n].astype(np.uint32)), pack(np.concatenate([start[s], k_start[k]])), pack(ids[here]), pack(texts[here]), pack(at[n:].astype(np.uint32)))


def _requests(window: int, parts: int, block_words: int):
    def run(batches):
        hashes = WordHashes()
        block = _Block(window, parts, hashes)

        def rows(block):
            for row in block.requests():
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _REQUEST, strict=True)], schema=_REQUEST)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                block.add(doc_id, text.as_py())
                if block.words >= block_words:
                    yield from rows(block)
                    block = _Block(window, parts, hashes)
        yield from rows(block)

    return run


def _answers(parts: int):
    def run(key, rows):
        h, ids, texts, starts, known = [], [], [], [], []
        for r in rows.to_batches():
            c = [r.column(i) for i in range(r.num_columns)]
            for i in range(r.num_rows):
                own = unpack(c[1][i], np.uint64)
                at, k_at = unpack(c[2][i], np.uint32), unpack(c[6][i], np.uint32)
                place, doc, text = unpack(c[3][i], np.uint32), unpack(c[4][i], np.int64), unpack(c[5][i], np.uint32)
                h.append(own)
                ids.append(doc[at])
                texts.append(text[at])
                starts.append(place[: len(at)])
                if len(k_at):
                    known.append((doc[k_at], text[k_at], place[len(at) :]))
        h, ids, texts, starts = (np.concatenate(x) for x in (h, ids, texts, starts))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        repeats = np.zeros(len(h), bool)
        if len(h):
            earliest = np.minimum.reduceat(ids[order], first)
            repeats[order] = ids[order] > np.repeat(earliest, np.diff(np.r_[first, len(h)]))
        ids = np.concatenate([ids[repeats], *(k[0] for k in known)])
        texts = np.concatenate([texts[repeats], *(k[1] for k in known)])
        starts = np.concatenate([starts[repeats], *(k[2] for k in known)])
        bucket = _bucket(ids, parts)
        order = np.lexsort((starts, ids, bucket))
        ids, texts, starts, bucket = ids[order], texts[order], starts[order], bucket[order]
        named, at = np.unique(bucket, return_index=True)
        ends = np.searchsorted(bucket, named, side="right")
        cut = [slice(a, b) for a, b in zip(at, ends, strict=True)]
        return pa.table([named, *([pa.array([pack(x[c]) for c in cut], pa.binary()) for x in (ids, texts, starts)])], schema=_ANSWER)

    return run


def intervals(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True, end exclusive."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _apply(window: int, with_text: bool):
    schema = _result_schema(with_text)

    def run(docs, answers):
        hashes = WordHashes()
        ids, texts, starts = ([np.concatenate([unpack(b, t) for b in answers[name]]) if answers.num_rows else np.empty(0, t)][0] for name, t in (("ids", np.int64), ("texts", np.uint32), ("starts", np.uint32)))
        order = np.lexsort((texts, ids))
        ids, texts, starts = ids[order], texts[order], starts[order]
        out = []
        for doc_id, has_id, text in zip(docs["key"].to_pylist(), docs["has_id"].to_pylist(), docs["text"], strict=True):
            text = text.as_py()
            words = words_of(text)
            covered = np.zeros(len(words) + 1, np.int64)
            if len(words) >= window:
                own = window_hashes(hashes.of(words), window)
                repeated = np.ones(len(own), bool)
                repeated[np.unique(own, return_index=True)[1]] = False
                a, b = np.searchsorted(ids, [doc_id, doc_id + 1]) if doc_id < (1 << 63) - 1 else (np.searchsorted(ids, doc_id), len(ids))
                mine = starts[a:b][texts[a:b] == _text_hash(text)]
                repeated[mine] = True
                at = np.flatnonzero(repeated)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + window, -1)
            gone = np.cumsum(covered)[: len(words)] > 0
            kept = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            row = {"doc_id": doc_id if has_id else None, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest(), "removed": [{"start": s, "end": e} for s, e in intervals(gone)]}
            out.append(row | {"kept_text": kept} if with_text else row)
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _result_schema(with_text: bool) -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", span), *([("kept_text", pa.string())] if with_text else [])])


def deduplicate(docs: DataFrame, window: int = WINDOW, with_text: bool = True, block_words: int = BLOCK_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), removed (word intervals, end exclusive,
    maximal) and, if asked for, kept_text.

    A word goes if a window over it starts earlier elsewhere: in a smaller doc_id, or before in the same document. Windows are judged on the
    input. A null text has no words; a missing doc_id comes before all others; rows that share a doc_id are judged each for itself against
    other ids, none of them being earlier than another. Only doc_id and text are read. Equal 64-bit hashes count as equal windows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // part_bytes), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.select(F.col("key").alias("doc_id"), "text").mapInArrow(_requests(window, parts, block_words), "part int, hashes binary, holders binary, starts binary, ids binary, texts binary, known binary")
    answered = asked.groupBy("part").applyInArrow(_answers(parts), "bucket int, ids binary, texts binary, starts binary")
    mixed = F.col("key").bitwiseAND(LOW) * MIX_LOW + F.shiftrightunsigned("key", 24).bitwiseAND(HIGH) * MIX_HIGH
    gathered = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned(mixed, 17), F.lit(parts)).cast("int"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>" + (", kept_text string" if with_text else "")
    return gathered.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(_apply(window, with_text), kind)


ORACLE = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest([md5(array_to_string(list_slice(w, i, i + 19), ' ')) FOR i IN range(1, len(w) - 18)]) AS h FROM d WHERE len(w) >= 20),
marked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM win),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM marked WHERE again) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
