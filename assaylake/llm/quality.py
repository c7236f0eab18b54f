"""Quality rules: fixed word and repetition rules, then divergence from language references.

Each document's histogram over character classes and over common words is compared with its language's reference by
Jensen-Shannon distance (base 2, so 0 to 1). The references are the summed histograms of all documents of the language
that pass the fixed rules, counted in a first pass over all texts: a few numbers for each language leave a task. They
are a table that is joined; only that of all languages together, which stands in for languages of few words, is collected.

A text without any common word is no further from its reference than the common words' share puts it (0.34 to 0.36 on
the test tables), and a short clean text is away from it by chance alone. The word limit therefore lies, in squared
distance, halfway between what a sample of the reference of the same number of words is expected to have and what a text
without common words has. The expected part of a cell with share p is min(p, (1 - p) / (8 n ln 2)): the second-order term
of a binomial count, or p where hardly any occurrence is expected. Where chance reaches the whole, nothing is rejected.

Each histogram has a minimum length of its own, below which it is not measured. The scan writes each document's counts
as a small table, from which references and verdicts follow, so texts are read once.

Defined cases: null text has no words and fails; a null language, one of few words, or a table without a column ``lang``
is held against the reference of all languages together; a distance that equals its limit is within it; repeated rows
repeat; an empty table gives no rows; texts of any length are read whole; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import byte_column, free_name, map_blocks, releasing, slices, written

#: Frequent words of the languages at hand, whose shares make up the word histogram.
COMMON_WORDS = {
    "de": "der die und das ist nicht ein eine zu von mit auf für im den dem des sich auch an es in",
    "en": "the of and to in a is that for was on be with as by at it from this are or an",
    "es": "de la que el en y a los se del las un por con una su para es al lo no más",
    "fr": "le la les de des et un une en que qui est pour dans du au ce pas sur se il ne",
}
_SPACE = re.compile(rb"[ \t-\r]")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Below so many words (characters) the word (character) histogram is not measured.
    guard_words: int = 50
    guard_chars: int = 200
    #: Distance from the language's reference above which a document goes: halfway between what 99.9 % of the good documents of
    #: the labeled test table keep within (0.21; their largest is 0.279) and the median of the junk (0.345).
    max_char_distance: float = 0.28
    #: Where the word limit lies between a sample of the reference (0) and a text without common words (1), in squared distance.
    word_limit: float = 0.5
    #: A language of fewer words has no reference of its own: at so many, chance is a fortieth of that of a text of guard_words.
    reference_words: int = 2000


def vocabulary(words: dict[str, str] | None = None) -> list[bytes]:
    return sorted({w.encode() for x in (words or COMMON_WORDS).values() for w in x.split()})


def _classes() -> np.ndarray:
    """Class of each byte, where the first byte of a longer character stands for the whole: 0 white space, 1 lower, 2 upper,
    3 digit, 4 sentence marks, 5 other ASCII, 6 the separator of menus, 7 Latin letters beyond ASCII, 8 Greek, 9 Cyrillic,
    10 Hebrew, Arabic and their like, 11 scripts of South Asia, 12 marks and symbols beyond ASCII, 13 East Asian scripts, 14
    other planes (emoji among them); 15: not counted."""
    out = np.full(256, 5)
    out[list(b" \t\n\r\x0b\x0c")] = 0
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[list(b".,;:!?'\"()-")] = 4
    out[ord("|")], out[0x80:0xC0] = 6, 15
    out[0xC0:0xCB], out[0xCD:0xD0], out[0xD0:0xD5], out[0xD5:0xE0], out[0xE0:0xE2], out[0xE3:0xEE], out[0xF0:] = 7, 8, 9, 10, 11, 13, 14
    out[[0xC2, 0xCB, 0xCC, 0xE2, 0xEE, 0xEF]] = 12
    return out


_CHARS = 15
_CLASS = np.eye(_CHARS + 1, dtype=np.int64)[_classes()][:, :_CHARS]


def measures(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    words = text.split()
    run = b"".join(words)
    chars = len(run) if run.isascii() else len(run.decode("utf-8", "replace"))
    symbols = sum(map(run.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    triples = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(triples)) < len(triples):
        seen, end = Counter(triples), 0
        for i, t in enumerate(triples):
            if seen[t] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, words


def failed(n_words: int, n_repeat: int, limits: Limits) -> bool:
    return n_words < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n_words


def histograms(text: bytes, words: list[bytes], common: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the character classes, and of each common word with all other words last."""
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    low = Counter(w.lower() for w in words)
    own = [low[w] for w in common]
    return chars, np.array([*own, len(words) - sum(own)], np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d, 0.0) / 2))


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, slots array<int>"


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def features(docs: DataFrame, limits: Limits = Limits(), words: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang, the counts of the fixed rules, and slots: the two histograms one after the other."""
    common = vocabulary(words)

    def block(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in byte_column(batch, "text"):
            *m, own = measures(text)
            chars, counts = histograms(text, own, common)
            rows.append((*m, failed(m[0], m[4], limits), np.concatenate([chars, counts])))
        cols = list(zip(*rows)) or [()] * 7
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang")} | {k: list(v) for k, v in zip(names, cols)}

    return map_blocks(_with_lang(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")), "text", block, "doc_id long, lang string, " + _COUNTS)


def references(counted: DataFrame) -> DataFrame:
    """lang, i, n: each language's summed histogram over the documents that pass the fixed rules. A null language is one too."""
    slots = counted.filter(~F.col("base_failed")).select("lang", F.posexplode("slots").alias("i", "n"))
    return slots.groupBy("lang", "i").agg(F.sum("n").alias("n"))


def _known(counted: DataFrame, limits: Limits) -> tuple[DataFrame, np.ndarray | None]:
    """_lang and _reference of each language with enough words; the reference of all languages together."""
    each = written(references(counted), "references")
    slots = F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"])
    n_words = F.sum(F.when(F.col("i") >= _CHARS, F.col("n")))
    own = each.filter("lang is not null").groupBy(F.col("lang").alias("_lang")).agg(slots.alias("_reference"), n_words.alias("_n")).filter(F.col("_n") >= limits.reference_words).drop("_n")
    total = each.groupBy("i").agg(F.sum("n").alias("n")).collect()
    return written(own, "own-references"), np.array([x["n"] for x in sorted(total, key=lambda x: x["i"])], np.int64) if total else None


def _references_of(batch: pa.RecordBatch, overall: np.ndarray | None, name: str = "_reference") -> list[np.ndarray | None]:
    """The reference of each row."""
    own: dict = {}
    at = batch.column(name)
    for i, lang in enumerate(langs := batch.column("lang").to_pylist()):
        if lang not in own:
            own[lang] = np.array(at[i].as_py(), np.int64) if at[i].is_valid else overall
    return [own[x] for x in langs]


def max_word_distance(n: int, ref: np.ndarray, limits: Limits = Limits()) -> float:
    """Limit of the word distance of a text of n words."""
    p = ref / ref.sum()
    chance = np.minimum(p, (1 - p) / (8 * n * math.log(2))).sum()
    without = distance(np.eye(len(ref))[-1], ref) ** 2
    return 1.0 if chance >= without else math.sqrt(chance + limits.word_limit * (without - chance))


def _divergence(slots: np.ndarray, n: int, chars: int, ref: np.ndarray | None, limits: Limits) -> tuple[float | None, float | None, bool]:
    """Both distances, null below their minimum length, and whether those that are measured are within the limits."""
    if ref is None:
        return None, None, True
    a = distance(slots[:_CHARS], ref[:_CHARS]) if chars >= limits.guard_chars else None
    b = distance(slots[_CHARS:], ref[_CHARS:]) if n >= limits.guard_words else None
    return a, b, (a is None or a <= limits.max_char_distance) and (b is None or b <= max_word_distance(n, ref[_CHARS:], limits))


def judge_quality(docs: DataFrame, limits: Limits = Limits(), words: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept."""
    counted = written(features(docs, limits, words), "quality")
    own, overall = _known(counted, limits)

    def block(batch: pa.RecordBatch) -> dict:
        cols = {k: batch.column(k).to_pylist() for k in ("n_words", "word_chars", "base_failed", "slots")}
        got = [_divergence(np.array(s), n, c, ref, limits) for ref, n, c, s in zip(_references_of(batch, overall), cols["n_words"], cols["word_chars"], cols["slots"])]
        same = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        return {k: batch.column(k) for k in same} | {"char_distance": [x[0] for x in got], "word_distance": [x[1] for x in got], "kept": [x[2] and not f for x, f in zip(got, cols["base_failed"])]}

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"
    return map_blocks(counted.join(own, counted["lang"] == own["_lang"], "left"), "lang", block, ddl)


def keep_good(docs: DataFrame, limits: Limits = Limits(), words: dict[str, str] | None = None) -> DataFrame:
    """The documents that ``judge_quality`` keeps, with all their columns. Reads the texts twice and moves none."""
    (own, overall), common = _known(features(docs, limits, words), limits), vocabulary(words)

    def good(ref: np.ndarray | None, text: bytes) -> bool:
        n, chars, _, _, repeat, own = measures(text)
        if failed(n, repeat, limits):
            return False
        slots = np.concatenate(histograms(text, own, common))
        return _divergence(slots, n, chars, ref, limits)[2]

    rows = _with_lang(docs)
    names = rows.columns
    lang, reference = (free_name(names, x) for x in ("_lang", "_reference"))
    known = own.withColumnsRenamed({"_lang": lang, "_reference": reference})
    added = len(names) - len(docs.columns)

    def run(batches):
        for b in (x for whole in batches for x in slices(whole, "text")):
            keep = [good(*x) for x in zip(_references_of(b, overall, reference), byte_column(b, "text"))]
            yield b.select(names[: len(names) - added]).filter(pa.array(keep, pa.bool_()))

    return rows.join(known, rows["lang"] == known[lang], "left").mapInArrow(releasing(run), docs.schema)
