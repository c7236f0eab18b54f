"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from assaylake.llm import ann, balls, bpe, chat, grammar, licenses, merkle, ngram_join, packing, quality, secrets, warc, wordpiece
from assaylake.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text. Null and empty texts have none, repeated rows repeat, an empty table gives no rows, texts of any length are scanned whole."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the bytes that they decode to, as digests. Null and empty texts have no tokens, repeated rows repeat, an empty table gives no rows."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every text. Null and empty texts count 0, repeated rows repeat, texts of any length are counted whole, an empty table gives no rows."""
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"))


def op4_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as read back from the shards. Null and empty texts are the end id alone, null doc_ids come first, an empty table gives no rows."""
    return grammar.shard_round_trip(table(spark, sf_dir, "documents"))


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text in packed sequences. Null and empty texts are the end id alone, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. Null and empty texts are linked with nothing, a null doc_id has a null component, texts of any length are compared whole, an empty table gives no rows."""
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every 50th vector. Null, zero and non-finite vectors take no part, components of any magnitude are scored alike, ties go to the smaller vec_id, an empty table gives no rows."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive. A null html is the empty payload, a null page_id comes after all others, repeated rows repeat, payloads of any length are kept whole, an empty table gives no rows."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every text. Null, empty and short texts have none, repeated rows repeat, texts of any length are scanned whole, an empty table gives no rows."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text. A null text has no words and fails, a null language is held against all languages together, texts of any length are judged whole, an empty table gives no rows."""
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op11_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from its formatted text. A null text is empty, a null role the empty role, rows that repeat are turns each, a row without a conv_id is a conversation of its own, an empty table gives the added conversation alone, texts of any length are formatted whole."""
    return chat.format_round_trip(chat.with_conflict(table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document. Nulls are marked in a leaf, a null language is a tree of its own, rows that repeat are leaves each, an empty table gives no rows, texts of any length are hashed whole."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 finite components. Others take no part, rows that repeat are vectors each, ties go to the smaller cluster, an empty table gives no rows, components of any magnitude are exact."""
    return balls.cluster_digests(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (op1_secret_scan, op2_bpe_round_trip, op3_token_counts, op4_grammar_shards, op5_bin_slack_packing, op6_ngram_jaccard_join, op7_learned_partitions, op8_warc_round_trip, op9_license_scan, op10_quality_rules, op11_chat_round_trip, op12_merkle_manifest, op13_ball_clusters)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    known = {"op8_warc_round_trip": warc.ORACLE_SQL, "op11_chat_round_trip": chat.ORACLE_SQL, "op12_merkle_manifest": merkle.oracle_sql(), "op13_ball_clusters": balls.oracle_sql(), "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in known.items() if v}
