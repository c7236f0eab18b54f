import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from assaylake.llm import bpe, grammar, packing, vocab, wordpiece
from assaylake.llm.pieces import PieceTable

ALPHABET = "ab the  \n\n\t'sllreVE09 ,.éÉ日本　\x1c\x85\0xßΣσ́"


def texts(n=400):
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, None, "", "a" * 4000, " " * 300 + "b", "x <|endoftext|> y", "the same text again.", "the same text again."]


def library(name):
    tk = Tokenizer.from_file(P.path(name))
    return lambda t: tk.encode(t or "", add_special_tokens=False).ids


def test_bpe_is_what_the_library_gives(spark, make):
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    all_texts = texts()
    got = {r["doc_id"]: r for r in bpe.encode_digests(make(all_texts)).collect()}
    for i, t in enumerate(all_texts):
        ids = tk.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.encode(make(["the end", None])).orderBy("doc_id").collect()
    assert bytes(full[0]["decoded"]) == b"the end" and full[1]["ids"] == ""


@pytest.mark.parametrize("table,name", [(vocab.byte_level, "byte_bpe_50k.json"), (vocab.word_level, "word_bpe_49k.json")])
def test_piece_tables(table, name):
    ids, made = library(name), [t or "" for t in texts()]
    flat, ends = table().block(made)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids(t) for t in made]


def test_piece_table_forgets_and_goes_on():
    ids, made = library("byte_bpe_50k.json"), [t or "" for t in texts(200)]
    own = PieceTable(vocab.byte_level().encode, spaced=True, most=50)
    for _ in range(3):
        flat, ends = own.block(made)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids(t) for t in made]


def greedy(word, vocabulary, prefix=b""):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if (prefix if i else b"") + word[i:j] in vocabulary), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match_automaton():
    rng = random.Random(3)
    for _ in range(3000):
        prefix = rng.choice([b"", b"##"])
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        if prefix:
            pieces = [prefix + p if rng.random() < 0.5 else p for p in pieces]
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9)))
        assert wordpiece.PieceCounter(pieces, prefix).count(word) == greedy(word, set(pieces), prefix)


def test_token_counts(spark, make):
    vocabulary = set(wordpiece.rank_pieces(P.path("byte_bpe_50k.tiktoken")))
    made = ["Hello hello  world's\n\nend", None, "", " \t ", "x" * 900]
    got = [tuple(r) for r in wordpiece.count_tokens(make(made)).orderBy("doc_id").collect()]
    want = [(i, len((t or "").encode().split()), sum(greedy(b" " + w, vocabulary) for w in (t or "").encode().split())) for i, t in enumerate(made)]
    assert got == want


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n, v in ((0, 5), (1, 5), (5000, 3), (60000, 2), (60000, 40)):
        ids, last = rng.integers(0, v, n).astype(np.uint32), np.zeros(n, bool)
        last[rng.integers(0, max(n, 1), n // 50)] = True
        last[-1:] = True
        rules, symbols, mark = grammar.compress(ids, last, v)
        counts = np.diff(np.append(-1, np.flatnonzero(last)))
        row = {"first": v, "rules": rules.astype("<u4").tobytes(), "lengths": grammar.expansion_lengths(rules, v).astype("<u4").tobytes(), "low": (symbols & 0xFFFF).astype("<u2").tobytes(), "high": (symbols >> 16).astype("u1").tobytes()}
        shard = grammar.Shard(row | {"counts": counts.astype("<i8").tobytes(), "places": np.append(0, np.flatnonzero(mark) + 1).astype("<i8").tobytes()})
        assert (shard.expand(shard.symbols) == ids).all()
        assert n < 5000 or len(symbols) < 0.9 * n
        ends = np.cumsum(counts)
        for _ in range(20 if n else 0):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (shard.ids(a, b) == ids[a:b]).all()
            i = rng.integers(len(counts))
            assert (shard.document(i) == ids[ends[i] - counts[i] : ends[i]]).all()


def test_shards(spark, make, tmp_path):
    ids, made = library("byte_bpe_50k.json"), texts(60)
    order = list(range(len(made)))
    random.Random(1).shuffle(order)
    got = [tuple(r) for r in grammar.shard_round_trip(make([made[i] for i in order], order)).orderBy("doc_id").collect()]
    want, at = [], 0
    for i, t in enumerate(made):
        x = ids(t) + [0]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want
    assert grammar.shard_round_trip(make(["x"]).filter("false")).count() == 0


def held(made, pieces, ids):
    whole = {i: ids(t) + [1] for i, t in enumerate(made)}
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in pieces:
        assert total == len(whole[doc]) and crc == zlib.crc32(np.array(whole[doc][start : start + length], "<u4").tobytes())
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, x in whole.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(x)
    fill = []
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
        fill.append(at)
    return sum(2048 - f for f in fill if f & (f - 1))


def test_packing(spark, make):
    rng = random.Random(5)
    made = [" ".join(rng.choice(["cat", "dog", "tree", "zzqx"]) for _ in range(rng.choice([0, 3, 100, 700, 1500, 1500, 1500, 5000]))) for _ in range(150)] + [None, ""]
    pieces = [tuple(r) for r in packing.pack_documents(make(made)).collect()]
    assert held(made, pieces, library("word_bpe_49k.json")) == 0
    assert packing.pack_documents(make(["x"]).filter("false")).count() == 0


def test_subset_sums_are_the_best():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        cap = rng.randint(1, 60)
        items = [k for k, v in counts.items() for _ in range(v)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        best, taken = packing.closest(counts, cap)
        assert best == max(s for s in sums if s <= cap) == sum(k * v for k, v in taken.items())
        assert all(v <= counts[k] for k, v in taken.items())


def test_plan_places_every_rank_once():
    histogram = {1500: 40, 548: 10, 300: 7, 1024: 5, 7: 3}
    places, line, _ = packing.plan_windows(histogram)
    for length, n in histogram.items():
        spans = sorted([(a, b) for k, a, b, _, _ in places if k == length] + [(a, b) for k, a, b, _ in line if k == length])
        assert [x for a, b in spans for x in range(a, b)] == list(range(n))


@pytest.mark.parametrize("n", [1, 3, 30, 200, 3000])
def test_windows_are_full_and_nearly_all_by_multisets(n):
    """Every id of every document lies in one place, sequences have no gaps, and only the last ones are short: powers of two."""
    rng = random.Random(n)
    lengths = [max(1, min(2047, int(rng.lognormvariate(5.5, 1.1)))) for _ in range(n)]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    places, stretches, line = packing.plan_windows(histogram)
    lookup, at = packing.Lookup(places, stretches, line), {}
    for length, count in histogram.items():
        for rank in range(count):
            pieces = lookup.pieces(length, rank)
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) == length
            for _, size, sequence, offset in pieces:
                at.setdefault(sequence, []).append((offset, size))
    for sequence, spans in at.items():
        spans.sort()
        assert [o for o, _ in spans] == [sum(x for _, x in spans[:i]) for i in range(len(spans))]
    totals = [sum(x for _, x in spans) for spans in at.values()]
    assert all(t == 2048 or t & (t - 1) == 0 for t in totals) and sum(t < 2048 for t in totals) <= 11
    assert sorted(at) == list(range(len(at)))
    placed = sum(k * (b - a) for k, a, b, _, _ in places)
    if n >= 200:  # what multisets place whole, of all ids
        assert placed > 0.97 * sum(lengths) and line.total - line.filled < 3 * 2048
