"""Token-id files: Arrow streams of fixed-size-list batches.

One file holds two Arrow streams, one after the other. The first has one row per sequence: ``input_ids``, a fixed-size list
of unsigned integers (16 bits if the vocabulary allows), and ``mask``, a fixed-size list of booleans that is false on
padding. Every batch but the last has the same number of rows, nothing is compressed and no list has its own offsets, so the
place of any sequence follows from its number and a memory-mapped file is read without copying. The second stream lists the
file's documents: doc_id, the place of the first id in the file, and the number of ids.

Documents follow one another in ascending doc_id order through the files of a folder, named by task and number. A document
lies in one file; only a file's last sequence is padded.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.session import checkpoint_dir, stage

from .tokens import encoder

SEQUENCE = 2048
ROWS = 512
END_ID = 2
FILE_IDS = 1 << 22
TOKENIZER = "byte_bpe_50k.json"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def stream_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("input_ids", pa.list_(pa.field("id", kind, nullable=False), length)), ("mask", pa.list_(pa.field("own", pa.bool_(), nullable=False), length))])


def write_streams(sink, docs: list[tuple[int | None, np.ndarray]], length: int = SEQUENCE, rows: int = ROWS, wide: bool = False) -> None:
    """Write documents (doc_id, ids) to an open file."""
    schema = stream_schema(length, wide)
    kind = "<u4" if wide else "<u2"
    ids = np.concatenate([d.astype(kind) for _, d in docs]) if docs else np.empty(0, kind)
    n = len(ids)
    full = np.zeros(-(-n // length) * length, kind)
    full[:n] = ids
    own = np.arange(len(full)) < n
    with pa.ipc.new_stream(sink, schema) as out:
        for at in range(0, len(full), rows * length):
            part = slice(at, at + rows * length)
            out.write_batch(pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(full[part], f.type.value_type), type=f.type) if k == 0 else pa.FixedSizeListArray.from_arrays(pa.array(own[part]), type=f.type) for k, f in enumerate(schema)], schema=schema))
    counts = [len(d) for _, d in docs]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("int64") if docs else np.empty(0, "int64")
    with pa.ipc.new_stream(sink, INDEX) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(starts), pa.array(counts, pa.int64())], schema=INDEX))


class SequenceFile:
    """Zero-copy reader of one file, from a memory map or a buffer."""

    def __init__(self, source):
        src = pa.BufferReader(source) if isinstance(source, (bytes, pa.Buffer)) else pa.memory_map(source) if isinstance(source, str) else source
        with pa.ipc.open_stream(src) as stream:
            self.batches = list(stream)
            self.length = stream.schema.field("input_ids").type.list_size
        with pa.ipc.open_stream(src) as stream:
            self.documents = stream.read_all()
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence, as views of the file."""
        batch, row = self.batches[i // self.rows], i % self.rows
        at = row * self.length
        ids, mask = batch.column(0), batch.column(1)
        return ids.values.slice(ids.offset * self.length + at, self.length).to_numpy(), mask.values.slice(mask.offset * self.length + at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place on; a view while they lie in one batch."""
        step, parts = self.rows * self.length, []
        while n > 0:
            batch = self.batches[start // step].column(0)
            own = batch.values.slice(batch.offset * self.length, len(batch) * self.length).to_numpy()[start % step : start % step + n]
            parts.append(own)
            start, n = start + len(own), n - len(own)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "uint16")


def _open(folder: str):
    """A file system and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = SEQUENCE, rows: int = ROWS, file_ids: int = FILE_IDS, escape: bool = True) -> DataFrame:
    """Write all documents under ``folder`` (shared by all executors) and return one row per file: file, part, number, n_docs,
    n_tokens, start (ids of all files before it).

    A null text counts as empty, its document is the end id alone. Rows without a doc_id come first; rows with equal doc_id
    follow one another by text. An empty table gives no file. A file is written under another name and then moved, and a repeated task writes the same
    files again, so a lost executor leaves no half file. Columns other than doc_id and text are not read.
    """
    end = np.array([end_id], "<u4")

    def put(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, escape), TaskContext.get().partitionId()
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        held, n, number = [], 0, 0

        def close():
            name = f"{part:07d}-{number:05d}.arrows"
            own = f"{path}/_writing-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as sink:
                write_streams(sink, held, length, rows, wide)
            store.move(own, f"{path}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_docs": len(held), "n_tokens": n}], schema=made)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.concatenate([np.frombuffer(enc.encode(text.as_py() or ""), "<u4"), end])
                held.append((doc_id, ids if wide else ids.astype("<u2")))
                n += len(ids)
                if n >= file_ids:
                    yield close()
                    held, n, number = [], 0, number + 1
        if held:
            yield close()

    made = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    files = stage(ordered.mapInArrow(put, "file string, part int, number int, n_docs long, n_tokens long"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Read a folder's files back, one row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), file, and sequence (of the file, where the document begins)."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("sequence", pa.int64())])

    def take(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                f = SequenceFile(content.as_buffer())
                index = f.documents.to_pydict()
                crc = [zlib.crc32(f.ids(s, n).astype("<u4").tobytes()) for s, n in zip(index["start"], index["n_tokens"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py().rsplit("/", 1)[-1]] * len(crc), pa.string()), pa.array(index["doc_id"], pa.int64()), pa.array(index["start"], pa.int64()), pa.array(index["n_tokens"], pa.int64()), pa.array(crc, pa.int64()), pa.array([s // f.length for s in index["start"]], pa.int64())], schema=schema)

    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, sequence long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrows").load(folder).select("path", "content")
    rows = found.mapInArrow(take, "file string, doc_id long, at long, n_tokens long, ids_crc32 long, sequence long")
    return rows.join(files.select("file", F.col("start").alias("base")), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "sequence")


def new_folder(spark) -> str:
    """A fresh folder for one set of files in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
