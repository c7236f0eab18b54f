"""Text predicates and transforms as column expressions. Patterns keep to what both regex dialects read alike or go through
``ascii_reading``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits evidence into tokens; a dot stays inside its token.
EVIDENCE_SPLIT = r"[\s\"'`:,;|\\\[\]{}()<>=]+"
# The scan's and the redaction's patterns, the order of redactions, and the words without content.
#: Kinds of personal data that the scan counts.
PII = {
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "medical_record": r"\bMRN[:\s-]?\d{6,}\b|\bMedical\s+Record\s+#?\s*\d{6,}\b",
    "insurance_number": r"\b(?:Policy|Insurance|Member|ID)[\s#:]*\d{6,}\b",
    "driver_license": r"\b[A-Z]{1,2}\d{6,}\b|\bDL[:\s-]?\d{6,}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b|\bPassport[:\s#]*\d{6,9}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "mac_address": r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
}
#: Replaced one after the other, in this order.
REDACTIONS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b\+?1?\s*\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "dob": r"(?i)\b(?:dob|date of birth|born on)\b[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    "mrn": r"(?i)\b(?:mrn|medical record number|patient id|patient identifier)\s*[:#]?\s*[A-Za-z0-9\-]{4,}\b",
    "address": r"(?i)\b\d{1,5}\s+[A-Za-z0-9.\- ]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b",
}
STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have her here his how into its "
    "may not now off our out per she should so some such than that the their them then there these they this those "
    "through thus to too was were what when where which while who whom why will with would yes you your yours"
).split()
CONTEXT = 50


def ascii_reading(pattern: str) -> str:
    r"""``pattern`` for Spark as SQL reads it: words at ``\b`` are ASCII letters, digits and underscores, ``\s`` is no vertical tab, and
    with ``(?i)`` the long s and the Kelvin sign are an s and a k. Spark's own ``\b`` holds letters of any script for words."""
    folds = {"s": "ſ", "k": "K"} if pattern.startswith("(?i)") else {}
    w = "[A-JL-RT-Za-jl-rt-z0-9]" if folds else "[A-Za-z0-9]"
    one = rf"(?:\\d|{w}|\[(?:\d-\d|[A-F]-[A-F]|[a-f]-[a-f]{'' if folds else '|[A-Z]-[A-Z]|[a-z]-[a-z]'})+\])"
    # one look is enough where what follows, or what comes before, is sure to be a character of a word
    follows = re.compile(rf"\(?{one}(?![?*]|{{0)|\(\?:(?:{w}\w*[ |])*{w}\w*\)(?![?*]|{{0)")
    precedes = re.compile(rf"(?:{one}(?:{{[1-9]\d*(?:,\d*)?}})?\)?|\(\?:(?:\w*{w}[ |])*\w*{w}\))\Z")
    out, inside = [], False
    for m in re.finditer(r"\(\?[a-z]*[:)]|\\.|[A-Za-z0-9]-[A-Za-z0-9]|.", pattern, re.S):
        x = m[0]
        if x == r"\b" and not inside:
            if follows.match(pattern, m.end()):
                x = r"(?<!\w)"
            elif precedes.search(pattern[: m.start()]):
                x = r"(?!\w)"
            else:
                x = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
        elif x == r"\s":
            x = r"\t\n\f\r " if inside else r"[\t\n\f\r ]"
        elif inside and len(x) == 3:
            x += "".join(c for k, c in folds.items() if x[0].lower() <= k <= x[2].lower())
        elif x.lower() in folds:
            x = x + folds[x.lower()] if inside else f"[{x}{folds[x.lower()]}]"
        elif x in "[]":
            inside = x == "["
        out.append(x)
    return "".join(out)


def words(text: Column, pattern: str) -> Column:
    """Distinct non-empty parts of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), pattern), lambda x: x != ""))


def overlap_ratio(quote: Column, text: Column) -> Column:
    """Share of the quote's tokens that the text has; 0 without tokens."""
    q, t = words(quote, EVIDENCE_SPLIT), words(text, EVIDENCE_SPLIT)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def containment_tokens(text: Column) -> Column:
    return words(text, "[^a-z0-9]+")


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; 0 where one is empty."""
    x, y = containment_tokens(a), containment_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def plain(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def runs(words: Column, n: int) -> Column:
    """Distinct runs of n words, each joined by spaces; none where there are fewer."""
    shifted = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - n + 1, F.lit(0))).alias(str(k)) for k in range(n)]
    return F.array_distinct(F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *[x[str(k)] for k in range(n)])))


def stem(token: Column) -> Column:
    """Drops ing or ed, else one trailing s (but not of ss), where three characters stay before it."""
    return (
        F.when((F.length(token) >= 6) & token.endswith("ing"), F.substring(token, F.lit(1), F.length(token) - 3))
        .when((F.length(token) >= 5) & token.endswith("ed"), F.substring(token, F.lit(1), F.length(token) - 2))
        .when((F.length(token) >= 4) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def salient_stems(text: Column, least: int = 4) -> Column:
    """Stems of the tokens that carry content: all numbers, and of the others those of ``least`` characters or more that are no stopword."""
    kept = F.filter(words(text, "[^a-z0-9]+"), lambda x: x.rlike("^[0-9]+$") | ((F.length(x) >= least) & ~x.isin(*STOPWORDS)))
    return F.array_distinct(F.transform(kept, stem))


def source_stems(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text, "[^a-z0-9]+"), stem))


def redacted(text: Column) -> Column:
    for kind, pattern in REDACTIONS.items():
        text = F.regexp_replace(text, ascii_reading(pattern), f"[REDACTED_{kind.upper()}]")
    return text


def matches(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_reading(PII[kind])))


def spans(text: Column, kind: str) -> Column:
    """Every match of a kind with its start, from 0, and the text around it, ``CONTEXT`` characters on either side."""
    pattern = ascii_reading(PII[kind])
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y))
    start = lambda i: length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i))
    around = lambda v, a: F.substring(text, F.greatest(a - CONTEXT, F.lit(0)) + 1, F.least(a, F.lit(CONTEXT)) + F.length(v) + CONTEXT)
    return F.transform(found, lambda v, i: F.struct(v.alias("value"), start(i).alias("start"), around(v, start(i)).alias("context")))


def head_and_tail(text: Column, most: int = 2000, each: int = 800) -> Column:
    """Texts beyond ``most`` characters keep their first and last ``each``."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, each), F.lit("\n...[truncated]...\n"), F.substring(text, -each, each))).otherwise(text)


def line_with(text: Column, token: Column) -> Column:
    """The first line that holds the token, case aside, trimmed; null without one."""
    return F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lower(token))), F.lit(0)))


def without_blank_runs(text: Column, marker: str) -> Column:
    """Drops lines that start with the marker and collapses runs of blank lines to one."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(marker))), "\n")
    return F.trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def title_slug(text: Column) -> Column:
    """Upper case; every run of other characters than letters and digits is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
