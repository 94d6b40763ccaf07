"""A corpus pipeline in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import mixing, near, packing, quality, secret_scan
from cohortry.llm.common import Staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays."""
    return near.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that the sources' words meet their targets."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Tokens and fingerprints are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
