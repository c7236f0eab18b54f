"""Corpus pipeline: quality rules, n-gram Jaccard join, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its predecessor kept. The first three return
the columns of ``documents``, extra ones included; the last returns the pieces of the packed sequences. Every stage takes
nulls in any column, empty and very long texts, repeated rows, empty tables (no rows then) and columns whose names it uses
itself; what becomes of them stands in each docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import ngram_join, packing, quality, secrets
from assaylake.llm.common import ship, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts go; a null language, or no column ``lang``, is held against
    all languages together; repeated rows stay or go together; documents without a doc_id are judged like others."""
    ship(spark)
    return quality.keep_good(docs)


#: Documents are near-duplicates from this Jaccard similarity of their shingles of so many words. op6 has its own figures.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents that with the smallest doc_id stays. Rows that repeat doc_id and text are one,
    rows that repeat the doc_id alone stay together; null and empty texts are linked with nothing; rows without a doc_id stay."""
    ship(spark)
    return ngram_join.keep_first_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and ``n_chars`` follows; every row stays, also repeated ones and those without doc_id or text."""
    ship(spark)
    return secrets.redact_secrets(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. Null and empty texts are the end id alone; repeated rows are packed each."""
    ship(spark)
    # the workers of earlier stages and their executors' heaps are still there: less memory here than where packing runs alone
    return packing.pack_documents(docs, block=3 << 20, pieces=120_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", sequence_packing),
]

#: Tokens, entropies and divergences are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
