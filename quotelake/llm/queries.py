"""The registered queries of this subpackage: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, katz, near_dups, neighbours, ngram_join, packing, resampling, secrets, shards, substrings, token_files, toxicity, whitening
from .common import fold_remainder, table


def op1_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    members = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), members)
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), (fold_remainder(doc_id, 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_power_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False, escape=False)


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("longest_match")


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).drop("set_key")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op6_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build_index(vectors), vectors, F.col("vec_id") % 20 == 0)


def op7_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op8_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), with_text=False).drop("removed")


def op9_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op10_arrow_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    files = token_files.write_files(table(spark, sf_dir, "documents"), folder, escape=False)
    return token_files.read_files(files, folder)


def op11_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_count_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_sets(table(spark, sf_dir, "documents"))


def op13_cholesky_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_nnpu": (op1_nnpu, None),
    "op2_power_pieces": (op2_power_pieces, None),
    "op3_suffix_automaton": (op3_suffix_automaton, decontaminate.ORACLE),
    "op4_odd_sketches": (op4_odd_sketches, near_dups.ORACLE),
    "op5_katz": (op5_katz, None),
    "op6_small_world": (op6_small_world, None),
    "op7_ownership": (op7_ownership, None),
    "op8_rabin_karp": (op8_rabin_karp, substrings.ORACLE),
    "op9_longest_first": (op9_longest_first, None),
    "op10_arrow_streams": (op10_arrow_streams, None),
    "op11_bisection": (op11_bisection, resampling.ORACLE),
    "op12_count_tree": (op12_count_tree, ngram_join.ORACLE),
    "op13_cholesky_qr": (op13_cholesky_qr, None),
}
