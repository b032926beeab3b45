"""A corpus pipeline of five of the training-data operators; see the README.

Each stage reads what the one before it kept: quality rules drop documents, the n-gram
join keeps one of each group of near duplicates, the secret scan replaces secrets, mixing
drops documents by their rates, and packing returns the pieces of what is left with
their sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardwatch.llm import mixing, ngram_join, packing, quality, secret_scan
from wardwatch.llm.queries import BYTE_BPE, MIXTURE, PIECE_BPE, domain_labels
from wardwatch.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, BYTE_BPE, PIECE_BPE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates_removed(docs, k=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, domain_labels(spark, sf_dir), MIXTURE, "clean")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing_weights", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

# Tokenisers, classifiers and iterated links are beyond SQL; tests hold each stage to a loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
