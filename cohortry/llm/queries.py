"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import chat, digest, language_model, mixing, negatives, packing, pii, quality, recount, secret_scan, sharding, simhash, trie
from cohortry.llm.common import table, text_or_empty


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return recount.recount(docs, recount.sample_edits(text_or_empty(docs)))


def op11_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii_boosting, op2_secret_linking, op3_best_fit_packing, op4_quartile_digest, op5_source_mixing, op6_simhash_near_dedup, op7_sharding, op8_perspective_rotation, op9_quality_rules, op10_edit_aware_counts, op11_pitman_yor_scores, op12_hard_negatives, op13_conversation_trie)
}

ORACLE_SQL = {"op8_perspective_rotation": chat.ORACLE, "op5_source_mixing": mixing.ORACLE, "op9_quality_rules": quality.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_conversation_trie": trie.ORACLE}
