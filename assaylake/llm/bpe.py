"""Byte-level BPE encoding and decoding by merge replay over blocks of the corpus.

A block's texts are cut into the tokenizer's words. Its distinct new words are laid out in one chain of byte tokens, and
an inverted index maps each mergeable token pair, under the rank of its merge, to the positions where it stands in the
words. The merges are then replayed in rank order over all words at once: the index is read in ascending bands of ranks,
each word applies its lowest merge first, and only the pairs of the two touched neighbours are looked up and indexed
anew. Each distinct word is encoded once per block and each text is put together from its words, so no row leaves its
partition and nothing is shuffled or broadcast; memory is bounded by the block and the cache. The words are distinct over a
block of 24 MB and what the cache keeps of the blocks before, not over the corpus; the README has the figures.

Text between two isolated spaces cannot change the words around it, so the texts are first cut at spaces, whose pieces
repeat more than whole texts do; only new pieces are matched against the pattern.

Defined cases: null and empty text have no tokens and the digest of nothing; a null doc_id passes through; special
tokens' strings are ordinary text; repeated rows repeat; an empty table gives no rows; extra columns are dropped; a word of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import map_blocks, text_column
from assaylake.llm.pieces import PieceTable, Spelling

#: Ranks read from the index at once.
BAND = 512
_NONE = np.int64(1 << 40)


class Ranks:
    """A rank file: the bytes of each token by id, and the rank of each pair of ids whose bytes join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        codes, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    codes.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes = np.append(np.array(codes, np.int64)[order], np.int64(2**62))
        self.merged = np.append(np.array(merged, np.int64)[order], _NONE)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.spelling = Spelling(tokens)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.merged[at], _NONE)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and their number for each word. A word that is a token is that token."""
    whole = np.array([ranks.ids.get(w, -1) for w in words], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    tok = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    nxt = np.arange(1, n + 1)
    nxt[first[size > 0] + size[size > 0] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[first[size > 0]] = -1
    direct = np.flatnonzero((whole >= 0) & (size > 0))
    busy = np.ones(n, bool)
    busy[np.repeat(whole >= 0, size)] = False

    rank = np.full(n, _NONE)
    at = np.flatnonzero(busy & (nxt >= 0))
    rank[at] = ranks.rank(tok[at], tok[at + 1])
    index: dict[int, list[np.ndarray]] = {}

    def post(at: np.ndarray) -> None:
        band = rank[at] // BAND
        order = np.argsort(band, kind="stable")
        at, band = at[order], band[order]
        cuts = np.flatnonzero(np.diff(band)) + 1
        for b, x in zip(band[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            index.setdefault(b, []).append(x)

    if len(at := at[rank[at] < _NONE]):
        post(at)
    for band in range(int(len(ranks.spelling.size)) // BAND + 1):
        now = index.pop(band, None)
        while now:
            at = np.concatenate(now)
            at = at[rank[at] < (band + 1) * BAND]  # the others have merged or changed since
            if not len(at):
                break
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            ranks_at, words_at = rank[at], word[at]
            group = np.flatnonzero(np.append(True, words_at[1:] != words_at[:-1]))
            lowest = np.minimum.reduceat(ranks_at, group)
            low = np.flatnonzero(ranks_at == np.repeat(lowest, np.diff(np.append(group, len(at)))))
            lead = low[np.append(True, words_at[low[1:]] != words_at[low[:-1]])]  # each word's lowest merge, leftmost
            left, rest = at[lead], np.delete(at, lead)
            right = nxt[left]
            after, before = nxt[right], prv[left]
            tok[left] = rank[left]
            tok[right] = -1
            nxt[left] = after
            rank[right] = _NONE
            rank[left] = _NONE
            has = after >= 0
            prv[after[has]] = left[has]
            rank[left[has]] = ranks.rank(tok[left[has]], tok[after[has]])
            had = before >= 0
            rank[before[had]] = ranks.rank(tok[before[had]], tok[left[had]])
            touched = np.concatenate([left[has], before[had]])
            soon = rank[touched] < (band + 1) * BAND
            now = [rest, touched[soon]]
            later = touched[~soon]
            if len(later := later[rank[later] < _NONE]):
                post(later)
    tok[~busy] = -1
    tok[first[direct]] = whole[direct]
    kept = tok >= 0
    return tok[kept], np.bincount(word[kept], minlength=len(words))


class WordEncoder:
    """Encodes strings: cuts them by the pattern and replays the merges over their distinct words."""

    def __init__(self, ranks: Ranks, pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        code, lengths = [], []
        for s in strings:
            words = self.find(s)
            lengths.append(len(words))
            for w in words:
                code.append(numbers.setdefault(w, len(numbers)))
        flat, count = replay([w.encode("utf-8", "surrogatepass") for w in numbers], self.ranks)
        code = np.array(code, np.int64)
        size = count[code]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(count) - count)[code] - (ends - size), size)]
        by_string = np.append(0, ends)[np.append(0, np.cumsum(lengths)).astype(np.int64)]
        return ids, np.diff(by_string)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined), decoded (bytes, from the ids) of each document."""
    return _encoded(docs, path, pattern, False)


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As ``encode``, with digests in place of ids and decoded bytes."""
    return _encoded(docs, path, pattern, True)


def _encoded(docs: DataFrame, path: str | None, pattern: str | None, digests: bool) -> DataFrame:
    def make() -> tuple[Ranks, PieceTable, Spelling]:
        import public_tokenizers

        ranks = load_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
        table = PieceTable(WordEncoder(ranks, pattern or public_tokenizers.PATTERN), spaced=True)
        return ranks, table, Spelling([b"%d," % i for i in range(len(ranks.spelling.size))])

    def block(state: tuple[Ranks, PieceTable, Spelling], batch: pa.RecordBatch) -> dict:
        ranks, table, decimal = state
        flat, ends = table.block(text_column(batch, "text"))
        each = [flat[a:b] for a, b in zip(ends, ends[1:])]
        ids = [decimal.of(x)[:-1] for x in each]
        decoded = [ranks.spelling.of(x) for x in each]
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in each]}
        if digests:
            return out | {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded]}
        return out | {"ids": [x.decode() for x in ids], "decoded": decoded}

    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded binary")
    return map_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", block, ddl, most=24 << 20, make=make)
