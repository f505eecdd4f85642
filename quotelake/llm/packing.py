"""Sequence packing by power-of-two decomposition.

A document's ids, with an end id, are cut from the front into pieces whose lengths are powers of two: full-length pieces
first, then the binary digits of what remains, largest first. Each piece is a sequence of its own. Pieces of one length
form a bucket, so a training batch takes equal-length sequences from one bucket, nothing is padded, and no sequence
crosses documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.session import stage

from .tokens import encoder

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: So many rows of counts (some 32 bytes each) are sent to every task; more are joined by key.
BROADCAST_COUNTS = 200_000


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids.

    >>> pieces_of(11, 4)
    [(0, 4), (4, 4), (8, 2), (10, 1)]
    """
    full = n // longest
    out = [(i * longest, longest) for i in range(full)]
    start, bit = full * longest, longest >> 1
    while bit:
        if (n - start) & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def decompose(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, longest: int = SEQUENCE, with_ids: bool = True, escape: bool = True) -> DataFrame:
    """The pieces of every document, before they are numbered.

    A null text counts as empty: its document is the end id alone. Repeated rows each give their own pieces; an empty table
    gives none. Columns other than doc_id and text are not read. With ``escape`` a special token's spelling is plain text.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    ids_field = [("input_ids", pa.list_(pa.int32()))] if with_ids else []
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), *ids_field]
    schema = pa.schema(fields)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        from pyspark import TaskContext

        enc, part, placed = encoder(tokenizer, escape), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in pieces_of(n, longest):
                    own = ids[4 * start : 4 * (start + length)]
                    place = placed.get(length, 0)
                    placed[length] = place + 1
                    rows.append((doc_id, start, length, zlib.crc32(own), n, part, place, *([np.frombuffer(own, "<i4")] if with_ids else [])))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long" + (", input_ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, spark_schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, longest: int = SEQUENCE, with_ids: bool = True, escape: bool = True) -> DataFrame:
    """Every piece with its sequence id: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket_row
    and, if asked for, input_ids (array<int>).

    sequence_id runs gapless from 0, bucket by bucket, longest first; bucket_row runs gapless in a bucket, so bucket and row
    range name a batch. The pieces are written once, so a repeated task cannot change a number that is in use. Only the
    counts per task and bucket (at most 1 + log2(longest) per task) are ordered in one place.
    """
    cut = stage(decompose(docs, tokenizer, end_id, longest, with_ids, escape))
    counts = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "part", "length",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(in_bucket), F.lit(0)).alias("bucket_base"),
    )
    if counts.count() <= BROADCAST_COUNTS:
        bases = F.broadcast(bases)
    return cut.join(bases, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        (F.col("bucket_base") + F.col("place")).alias("bucket_row"),
        *(["input_ids"] if with_ids else []),
    )

