"""Secret scans: fixed rules plus sliding-window Shannon entropy per character class.

Every text is scanned whole in one pass. Candidate strings are runs of 20 or more key-like characters; within a
candidate, each character class (hex digits, base64 digits) gets a window whose symbol counts, and counts of lower case,
upper case and digits, are kept incrementally: one symbol enters and one leaves per step, and only their terms of
``sum(c * log2 c)`` change. The terms are integers, so a window's sum does not depend on the steps before it. Windows at
or above the class's threshold are joined into spans.

The allow-list is searched once in a candidate that has a span. A span that lies within one of its matches is suppressed;
words such as "example" excuse what stands within 16 characters of them, not the whole candidate. Spans that mostly count
up or down by one (alphabets, digits in order, repeats) are suppressed too.

Defined cases: a null or empty text has no spans; a null doc_id passes through; repeated rows give repeated results; an
empty table gives no rows; extra columns are dropped; spans of one kind never overlap, spans of different kinds may; ties
of start are listed by kind; a candidate of any length costs time in proportion to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import map_blocks, releasing, slices, text_column

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` are searched with windows of ``window`` symbols; at least ``mixed`` of lower, upper, digit must occur."""

    kind: str
    chars: str
    window: int
    threshold: float
    mixed: int = 2


CLASSES = (
    CharClass("entropy_hex", r"[0-9a-fA-F]", 24, 3.0),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_-]", 20, 3.9),
)

#: Strings that look random but are public, as patterns, or as patterns with the number of characters around a match that it excuses.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    (r"(?i)example|placeholder|changeme|dummy|sample|your[_-]", 16),
    r"/[a-z0-9_/-]+/[a-z0-9_/-]*",
)
#: Lower case, upper case, digits, others.
_KIND = {chr(c): 0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(128)}


@dataclass
class Scanner:
    classes: tuple[CharClass, ...] = CLASSES
    allow: Iterable[str | tuple[str, int]] = ALLOW
    _runs: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        self._runs = [(c, re.compile(c.chars + "{%d,}" % c.window)) for c in self.classes]
        self._allow = [(re.compile(x), 0) if isinstance(x, str) else (re.compile(x[0]), x[1]) for x in self.allow]
        top = max((c.window for c in self.classes), default=1)
        self._term = [0] + [round(n * math.log2(n) * (1 << 40)) for n in range(1, top + 1)]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind index, end) of the fixed rules."""
        spans = []
        if ":" in text or "=" in text:
            spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        return spans

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        spans = self.base(text)
        for m in _CANDIDATE.finditer(text):  # a run of hex digits or of an access key lies within one candidate
            s, at = m.group(), m.start()
            if "AKIA" in s:
                spans += [(at + x.start(), 1, at + x.end()) for x in _ACCESS.finditer(s) if x.end() - x.start() >= 20]
            spans += [(at + x.start(), 2, at + x.end()) for x in _HEX.finditer(s) if x.end() - x.start() >= 24]
            spans += self.entropy(s, at)
        spans.sort()
        return spans

    def entropy(self, s: str, at: int) -> list[tuple[int, int, int]]:
        """Spans of a candidate that starts at ``at``."""
        out, public = [], None
        for c, runs in self._runs:
            for m in runs.finditer(s):
                for a, b in self._windows(m.group(), c):
                    a, b = a + m.start(), b + m.start()
                    if public is None:
                        public = self._public(s)
                    if not self._allowed(public, s, a, b):
                        out.append((at + a, KINDS.index(c.kind), at + b))
        return out

    def _windows(self, s: str, c: CharClass) -> list[tuple[int, int]]:
        """Unions of the windows at or above the threshold."""
        w, term, counts, total, kinds = c.window, self._term, dict.fromkeys(s, 0), 0, [0, 0, 0, 0]
        kind = {x: _KIND.get(x, 3) for x in counts}
        found: list[list[int]] = []
        need = (math.log2(w) - c.threshold) * w * (1 << 40) + 1000  # entropy = log2(w) - sum(c log2 c) / w; 1000 for rounding
        for i, x in enumerate(s):
            if i >= w:
                y = s[i - w]
                n = counts[y]
                total += term[n - 1] - term[n]
                counts[y] = n - 1
                kinds[kind[y]] -= 1
            n = counts[x]
            total += term[n + 1] - term[n]
            counts[x] = n + 1
            kinds[kind[x]] += 1
            if total <= need and i >= w - 1 and (kinds[0] > 0) + (kinds[1] > 0) + (kinds[2] > 0) >= c.mixed:
                a = i - w + 1
                if found and a <= found[-1][1]:
                    found[-1][1] = i + 1
                else:
                    found.append([a, i + 1])
        return [(a, b) for a, b in found]

    def _public(self, s: str) -> tuple[list[int], list[int]]:
        """Starts of the allow-list's matches in order, and for each the furthest end so far."""
        places = sorted((max(0, m.start() - around), m.end() + around) for x, around in self._allow for m in x.finditer(s))
        return [a for a, _ in places], list(accumulate((b for _, b in places), max))

    @staticmethod
    def _allowed(public: tuple[list[int], list[int]], s: str, a: int, b: int) -> bool:
        i = bisect_right(public[0], a)
        if i and public[1][i - 1] >= b:
            return True
        steps = sum(abs(ord(y) - ord(x)) <= 1 for x, y in zip(s[a:b], s[a + 1 : b]))
        return steps * 2 >= b - a  # alphabets, digits in order, repeats


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, allow: Iterable[str | tuple[str, int]] = ALLOW, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans for each document."""
    allow = tuple(allow)

    def block(scanner: Scanner, batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
        for text in text_column(batch, "text"):
            spans = scanner.scan(text)
            base = [x for x in spans if x[1] < 3]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in base))
            out["n_entropy"].append(len(spans) - len(base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out | {"doc_id": batch.column("doc_id")}

    return map_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", block, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", make=lambda: Scanner(classes, allow))


def redact(text: str, scanner: Scanner) -> str:
    """The text with each group of overlapping spans replaced by ``[SECRET]``."""
    out, last = [], 0
    for a, _, b in scanner.scan(text):
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; rows and columns stay, ``n_chars`` follows the new text."""
    fields = docs.schema

    def run(batches):
        scanner = Scanner()
        for b in (x for whole in batches for x in slices(whole, "text")):
            old = b.column("text").to_pylist()
            new = [x if x is None else redact(x, scanner) for x in old]
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, b.schema.field("text").type))
            if "n_chars" in b.schema.names:
                at = b.schema.get_field_index("n_chars")
                was = b.column(at).to_pylist()
                b = b.set_column(at, "n_chars", pa.array([w if x == y or y is None else len(y) for w, x, y in zip(was, old, new)], b.schema.field(at).type))
            yield b

    return docs.mapInArrow(releasing(run), fields)
