"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, token counts.

Defined cases: documents whose text is null or empty go in the first stage, as they break its base rule; rows with a null
doc_id are documents of their own, which the near-duplicate stage keeps; repeated rows share their fate in every stage but
that one, which keeps all rows of the smallest id of a group; very long texts are read whole; in an empty table every stage gives
no rows; extra columns, whatever their names, go through to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, mixing, quality, secrets
from tidemark.llm.common import run_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.apply(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at Jaccard 0.8 or more the smallest id stays."""
    return jaccard.keep_one(docs, 5, 80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring the domains to their target weights."""
    return mixing.apply(docs, table(spark, sf_dir, "labels"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains."""
    return bpe.digest(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
