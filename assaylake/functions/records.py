"""Scalar rules over names, replies and records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Specialties by keyword in order of precedence, verdict markers, and marker lines.
SPECIALTIES = (
    ("neurology", "neurology"),
    ("hiv", "neurology"),
    ("lumbar", "neurology"),
    ("puncture", "neurology"),
    ("kidney", "nephrology"),
    ("blood_cancer", "oncology"),
    ("cancer", "oncology"),
    ("polycythemia", "oncology"),
    ("psychology", "psychiatry"),
    ("psych", "psychiatry"),
    ("diabetes", "endocrinology"),
    ("pediatrics", "pediatrics"),
    ("seizure", "pediatrics"),
    ("splinter", "emergency"),
    ("foreign", "emergency"),
    ("injury", "emergency"),
    ("negative", "general"),
)
VERDICT_MARKERS = ("appr", "rej", "need")
MARKER_LINES = ("<!-- verification -->", "<!-- /verification -->")
DOSE = r"(\d+(?:\.\d+)?\s*(?:MG|mg|ML|ml|MCG|mcg|G|g|UNIT|UNITS))"
GENDERS = {"male": "M", "female": "F", "other": "O", "unknown": "U"}


def dose(description: Column) -> Column:
    found = F.regexp_extract(description, DOSE, 1)
    return F.when(found != "", found).otherwise("as directed")


def without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\d+$", "")


def case_number(name: Column) -> Column:
    """The number after "Case", 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"Case[_\s-]?0*(\d+)", 1), F.lit("")).cast("long"), F.lit(0))


def specialty(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for word, kind in SPECIALTIES:
        out = out.when(F.contains(F.lower(name), F.lit(word)), kind)
    return out.otherwise("general")


def item_tokens(value: Column, dosage: str, least: int = 4, noise: tuple[str, ...] = ()) -> Column:
    """Distinct words of letters, of ``least`` or more, after the dosage is taken out."""
    words = F.split(F.lower(F.regexp_replace(value, "(?i)" + dosage, " ")), "[^a-z]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*noise) if noise else F.length(w) >= least))


def term(text: Column) -> Column:
    """Lower case; all but letters, digits and spaces is a space; runs of spaces are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))


def semantic_tag(name: Column) -> Column:
    """What stands in brackets at the end of a name, null without it."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(name, r"\(([^()]+)\)\s*$", 1))), F.lit(""))


def claim_in_chunk(claim: Column, chunk: Column) -> Column:
    """Do the claim's words of four letters or more, if it has any, meet the chunk's."""
    words = F.filter(F.split(term(claim), " "), lambda w: F.length(w) >= 4)
    return F.size(F.array_intersect(words, F.split(term(chunk), " "))) > 0


def stands_whole(value: Column, text: Column) -> Column:
    """Does the normalized value stand in the normalized text between word ends."""
    return (term(value) != "") & F.contains(F.concat(F.lit(" "), term(text), F.lit(" ")), F.concat(F.lit(" "), term(value), F.lit(" ")))


def first_values(text: Column, pattern: str) -> Column:
    """Matches of a pattern, case aside, one for each normalized form in the spelling that comes first."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))
    forms = F.transform(found, lambda x: F.lower(x))
    return F.filter(found, lambda x, i: F.array_position(forms, F.lower(x)) == i + 1)


def clean_lines(text: Column) -> Column:
    """Without marker lines; three line ends become two; trimmed."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).isin(*MARKER_LINES)), "\n")
    return F.regexp_replace(F.replace(kept, F.lit("\n\n\n"), F.lit("\n\n")), r"^\s+|\s+$", "")


def without_sentences(line: Column, sentences: Column) -> Column:
    """The line without the given sentences, each taken out; null where one does not stand there or nothing is left."""
    parts = F.filter(F.split(line, r"(?<=[.!?]) +"), lambda s: s != "")
    kept = F.array_except(parts, sentences)
    return F.when((F.size(F.array_except(sentences, parts)) == 0) & (F.size(kept) > 0), F.array_join(F.filter(parts, lambda s: ~F.array_contains(sentences, s)), " "))


def without_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, "^```[^\n]*\n?", ""), "\n?[ \t]*```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def chunk_id(*candidates: Column, text: Column) -> Column:
    """The first candidate that is not blank, else a slug of the text's first 16 characters; null without either."""
    named = [F.nullif(F.trim(c), F.lit("")) for c in candidates]
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.substring(F.trim(text), 1, 16)), "[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.coalesce(*named, F.nullif(slug, F.lit("")))


def verdict_confidence(tokens: Column) -> Column:
    """exp of the log-probability of the first token that begins a verdict, rounded to 6, 1 above 0; null without one.

    ``tokens`` is an array of structs token, logprob."""
    plain = lambda x: F.regexp_replace(F.lower(F.trim(x)), '^"+|[",]+$', "")
    marked = F.filter(tokens, lambda t: plain(t["token"]).rlike("^(" + "|".join(VERDICT_MARKERS) + ")"))
    p = F.get(marked, F.lit(0))["logprob"]
    return F.when(p.isNull(), None).when(p > 0, 1.0).otherwise(F.round(F.exp(p), 6))


def decision_score(decision: Column) -> Column:
    """reject 0, needs_review 0.5, approve 1; others null."""
    return F.when(decision == "reject", 0.0).when(decision == "needs_review", 0.5).when(decision == "approve", 1.0)


def reward_verdict(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, "approve").when(score.isNotNull(), "reject")
