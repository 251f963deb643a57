"""Corpus pipeline: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. The first three return the
columns of ``documents``: rejected documents go, one document of every group of
near duplicates (five-word shingles, similarity 0.8 or more) stays, and reported
secrets are replaced in the texts. The last packs what is left into sequences.

Empty tables, nulls, empty and repeated rows are handled as each operator's
module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gravis.llm.common import land, prepare, table
from gravis.llm.credentials import redact
from gravis.llm.jaccard import drop_near_duplicates
from gravis.llm.packing import packed_sequences
from gravis.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_near_duplicates(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packed_sequences(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

# Covariance estimates, graph components and tokenizer ids are outside SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
