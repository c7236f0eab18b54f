"""Token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of pieces that following it pops, both
computed once in breadth-first order, so a word is counted in time linear in its length and no piece is ever built:
on a missing edge the pops are added and the walk goes on from the failure link. Continuation pieces may have their own
root (``prefix="##"``); with an empty prefix both roots are one.

Defined cases: null or empty text and text of white space only count 0; a word that no sequence of pieces spells counts
as one unknown piece; a null doc_id passes through; repeated rows repeat; an empty table gives no rows; a word of any
length takes time in proportion to it; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import Bounded, byte_column, map_blocks


class PieceCounter:
    """Counts pieces of a word given as bytes."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b""):
        go: dict[int, int] = {}  # node << 8 | byte -> node
        fail: list[int] = [-1]
        pops: list[int] = [0]
        whole: list[bool] = [False]
        top = 0
        order: list[tuple[int, int, int]] = []  # parent, byte, node

        def insert(root: int, piece: bytes) -> None:
            node = root
            for c in piece:
                key = node << 8 | c
                nxt = go.get(key)
                if nxt is None:
                    nxt = go[key] = len(fail)
                    fail.append(-1)
                    pops.append(0)
                    whole.append(False)
                    depth.append(depth[node] + 1)
                    order.append((node, c, nxt))
                node = nxt
            whole[node] = True

        depth = [0]
        if prefix:
            top = 1
            fail.append(-1)
            pops.append(0)
            whole.append(False)
            depth.append(0)
        for piece in vocabulary:
            if prefix and piece.startswith(prefix) and len(piece) > len(prefix):
                insert(top, piece[len(prefix) :])
            elif piece:
                insert(0, piece)
        order.sort(key=lambda x: depth[x[2]])
        for u, c, v in order:
            if whole[v]:
                fail[v], pops[v] = top, 1
                continue
            z, n = fail[u], pops[u]
            while z >= 0 and (z << 8 | c) not in go:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = go[z << 8 | c], n
        self.go, self.fail, self.pops, self.top = go, fail, pops, top

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in word:
            nxt = go.get(node << 8 | c)
            while nxt is None:
                f = fail[node]
                if f < 0:
                    return 1
                n += pops[node]
                node = f
                nxt = go.get(node << 8 | c)
            node = nxt
        while node not in (0, self.top):
            if fail[node] < 0:
                return 1
            n += pops[node]
            node = fail[node]
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(rank_pieces(path))


def rank_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 piece and rank on each line."""
    import base64

    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens by longest match over the pieces of ``vocabulary`` (a rank file's path).

    Words are what ASCII white space separates; each is looked up with the leading space that the vocabulary's
    word-initial pieces carry.
    """

    def make():
        import public_tokenizers

        counter = _counter(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        return Bounded(lambda w: counter.count(b" " + w))

    def block(cache: Bounded, batch: pa.RecordBatch) -> dict:
        get, words, tokens = cache.__getitem__, [], []
        for text in byte_column(batch, "text"):
            w = text.split()
            words.append(len(w))
            tokens.append(sum(map(get, w)))
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens}

    return map_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", block, "doc_id long, n_words long, n_tokens long", make=make)
