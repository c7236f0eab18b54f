"""Grounding of single texts: spans against the texts of their row, values, personal data, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions import text as t


def valid_spans(spans: DataFrame, least: float = 0.8, omissions: tuple[str, ...] = ("MISSING_ALLERGY",)) -> DataFrame:
    """Spans (case_id, code, quote) against the texts of their row (transcript, source, artifact), with ``valid``.

    A span stands from an overlap of ``least`` with the texts together; omissions are held against transcript and source
    alone. Where there is no text, nothing is checked and the span stands.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat_ws("\n", part("transcript"), part("source"))
    corpus = F.when(F.col("code").isin(*omissions), said).otherwise(F.concat_ws("\n", said, part("artifact")))
    valid = (F.trim(F.replace(corpus, F.lit("\n"), F.lit(" "))) == "") | (t.overlap_ratio(F.col("quote"), corpus) >= least)
    return spans.select("case_id", "code", valid.alias("valid"))


def value_presence(docs: DataFrame, pattern: str) -> DataFrame:
    """Values that the pattern finds in the first line must stand in the rest; null with nothing to check."""
    first, rest = F.split_part("text", F.lit("\n"), F.lit(1)), F.expr("substring(text, instr(text, '\n') + 1)")
    values = F.array_distinct(F.transform(F.regexp_extract_all(first, F.lit(pattern), F.lit(0)), F.lower))
    found = F.size(F.filter(values, lambda v: F.contains(F.lower(rest), v)))
    return docs.select(F.col("doc_id").alias("case_id"), F.size(values).cast("long").alias("checked"), F.when(F.size(values) > 0, found == F.size(values)).alias("conforms"))


def pii_scan(docs: DataFrame) -> DataFrame:
    """Occurrences of each kind of personal data."""
    return docs.select("doc_id", *[t.matches(F.col("text"), k).cast("long").alias(k) for k in t.PII])


def pii_spans(docs: DataFrame) -> DataFrame:
    """Every occurrence of personal data: its kind, start, value and context."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), t.spans(F.col("text"), k).alias("found")) for k in t.PII])
    return docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.kind", F.explode("x.found").alias("y")).select("doc_id", "kind", F.col("y.start").cast("long").alias("start"), "y.value", "y.context")


def redaction(docs: DataFrame) -> DataFrame:
    """Length and digest of each text after redaction, and the number of marks."""
    out = t.redacted(F.col("text"))
    return docs.select("doc_id", F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("digest"), F.regexp_count(out, F.lit(r"\[REDACTED_[A-Z]+\]")).cast("long").alias("marks"))


def medication_presence(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Disproved where any word of an item's name, of four letters or more, stands in the text joined by key."""
    words = F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda w: F.length(w) >= 4)
    return items.join(texts, "key").select("key", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("disproved"))
