"""A training-data pipeline over ``documents``: five stages, each written before the next one reads it.

Toxic documents go, one document of each near-duplicate group stays, benchmark passages are cut out, live-looking secrets are
masked, and what remains is packed into equal-length pieces of token ids. Nothing else of a document changes.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from quotelake.llm import decontaminate, near_dups, packing, secrets, toxicity
from quotelake.llm.common import table
from quotelake.session import checkpoint_dir, owning, release


#: Rows that go to Python at once: whole documents are wide, and a batch stands in memory on both sides.
BATCH_ROWS = 1_000

#: Folders the last stage wrote for itself. The next stage deletes them: by then the last one's rows are written.
_own: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _own)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with owning(_own):
            return f(spark, docs, sf_dir)

    return wrapped


@_stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifiers score below 0.5."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates, and all documents without one."""
    return near_dups.keep_first(docs)


@_stage
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark goes."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


@_stage
def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking secrets masked."""
    return secrets.redact(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their ids."""
    return packing.pack(docs, escape=False)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", one_of_each),
    ("decontamination", benchmark_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: The classifiers, the automaton and the tokenizer have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, before)
        before.append(path)
    release(spark, _own)
    return docs
