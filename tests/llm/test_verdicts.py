"""Verdicts of the quality rules against a plain version, recall of the search on the given table, records and templates."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from assaylake.llm import ann, grammar, licenses, quality, warc

SF = "/root/testdata/sf0.01"


def script(c):
    """Class of a character, by its code point."""
    n = ord(c)
    if c in " \t\n\r\x0b\x0c":
        return "space"
    if n < 128:
        return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "mark" if c in ".,;:!?'\"()-" else "menu" if c == "|" else "other"
    for end, name in ((0xC0, "symbol"), (0x2C0, "latin"), (0x340, "symbol"), (0x400, "greek"), (0x540, "cyrillic"), (0x800, "semitic"), (0x2000, "indic"), (0x3000, "symbol"), (0xE000, "eastern"), (0x10000, "symbol")):
        if n < end:
            return name
    return "beyond"


def plain_verdicts(rows, limits):
    """Kept or not of (id, lang, text), with dictionaries and without any of the module's arrays."""
    common = {w for x in quality.COMMON_WORDS.values() for w in x.split()}
    common = {w.encode() for w in common}
    seen = []
    for i, lang, text in rows:
        words = (text or "").encode().split()
        triples = Counter(zip(words, words[1:], words[2:]))
        held = {j for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in (k, k + 1, k + 2)}
        bad = len(words) < limits.min_words or 100 * len(held) > limits.max_repeat_percent * len(words)
        chars = Counter(map(script, text or ""))
        low = Counter(w.lower() if w.lower() in common else None for w in words)
        seen.append((i, lang, bad, sum(len(w.decode()) for w in words), len(words), chars, low))
    refs = {}
    for _, lang, bad, _, _, chars, low in seen:
        if not bad:
            for key in (lang, ...):
                a, b = refs.setdefault(key, (Counter(), Counter()))
                a.update(chars), b.update(low)

    def js(p, q):
        sp, sq = sum(p.values()), sum(q.values())
        d = 0.0
        for k in set(p) | set(q):
            x, y = p[k] / sp, q[k] / sq
            m = (x + y) / 2
            d += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
        return math.sqrt(max(d, 0) / 2)

    out = {}
    for i, lang, bad, n_chars, n, chars, low in seen:
        ref = refs.get(lang) if lang is not None else None
        if ref is None or sum(ref[1].values()) < limits.reference_words:
            ref = refs.get(...)
        good = not bad
        if ref and good:
            if n_chars >= limits.guard_chars:
                good &= js(chars, ref[0]) <= limits.max_char_distance
            if n >= limits.guard_words:
                total = sum(ref[1].values())
                chance = sum(min(v / total, (1 - v / total) / (8 * n * math.log(2))) for v in ref[1].values())
                without = js(Counter({None: 1}), ref[1]) ** 2
                good &= chance >= without or js(low, ref[1]) <= math.sqrt(chance + limits.word_limit * (without - chance))
        out[i] = good
    return out


def prose(rng, lang, n):
    common = quality.COMMON_WORDS[lang].split()
    own = [f"{lang}wort{k}" for k in range(300)]
    return " ".join((rng.choice(common) if rng.random() < 0.45 else rng.choice(own)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_kept_matches_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for i in range(190):
        lang = rng.choice(["de", "en", "fr", None, "xx"])
        text = prose(rng, lang if lang in quality.COMMON_WORDS else "en", rng.randint(20, 200))
        kind = i % 20
        if kind == 1:
            text = " | ".join(f"Menu{k}" for k in range(rng.randint(50, 90)))
        elif kind == 2:
            text = " ".join(rng.choice("αβγδεζηθ") * 5 + str(k) for k in range(rng.randint(60, 90)))
        elif kind == 3:
            text = " ".join("%d#%d" % (rng.randint(0, 9), k) for k in range(rng.randint(60, 90)))
        elif kind == 4:
            text = (text + " ") * 2
        rows.append((i, lang, text))
    rows += [(200, "en", None), (201, "en", "")]
    limits = quality.Limits()
    docs = spark.createDataFrame([(i, t, g) for i, g, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, limits).collect()}
    want = plain_verdicts(rows, limits)
    assert got == want and 60 < sum(want.values()) < 150
    assert {r["doc_id"] for r in quality.keep_good(docs, limits).collect()} == {i for i, k in want.items() if k}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_recall_on_the_embeddings_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(got[ids[i]] & set(ids[np.argsort(-s)[:5]].tolist()))
        total += 5
        assert len(got[ids[i]]) == 5
    assert hits / total >= 0.9


def test_a_query_in_a_small_part_gets_its_full_number(spark):
    """Tight clusters of three: the parts that a query visits hold too few, so it visits all."""
    rng = np.random.default_rng(2)
    rows = [(3 * c + j, (np.eye(64)[c] * 5 + rng.standard_normal(64) * 0.01).tolist()) for c in range(64) for j in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(table, every=3, k=5, plan=ann.Plan(parts=16, recall=0.1)).groupBy("query_id").count().collect()
    assert len(found) == 64 and {r["count"] for r in found} == {5}


def test_parts_grow_with_the_vectors():
    plan = ann.Plan()
    assert [ann.parts_for(n, plan) for n in (500, 51_282, 10**7, 10**9)] == [16, 56, 790, 1024] and [ann.sample_for(n, plan) for n in (500, 51_282, 10**7, 10**9)] == [4096, 4096, 25_280, 32_768] and ann.parts_for(10**9, ann.Plan(parts=8)) == 8


def test_records_are_whole_and_their_ids_distinct(spark, tmp_path):
    rows = [(1, "u1", "same é"), (2, "u2", "same é"), (3, None, None), (4, "u4\r\nX: y", "é" * 500_000), (None, "n", "same é"), (None, "n", "same é"), (2, "u2", "same é")]
    folder = f"file://{tmp_path}/w"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, date="2024-01-02T03:04:05Z")
    records = [bytes(r["record"]) for r in warc.read_archive(spark, folder).collect()]
    heads = [x.split(b"\r\n\r\n")[0].decode() for x in records]
    ids = [re.search("WARC-Record-ID: (.*)", h)[1] for h in heads]
    assert len(records) == len(rows) == len(set(ids))
    for h in heads:
        assert h.startswith("WARC/1.1\r\n") and "\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n" in h and all(": " in x for x in h.split("\r\n")[1:])
        if "WARC-Type: revisit" in h:
            assert re.search("WARC-Refers-To: (.*)", h)[1] in ids
        else:
            assert "\r\nContent-Type: text/html; charset=utf-8\r\n" in h
    got = {(r["page_id"], r["record_type"]): r["payload_bytes"] for r in warc.archive_index(spark, folder).collect()}
    assert got[4, "response"] == 1_000_000 and got[1, "revisit"] == 7 and got[2, "revisit"] == 7


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 40, 30_000), np.tile(rng.integers(0, 40, 50), 300), np.full(3000, 7)]).astype(np.int64)
    last = np.zeros(len(ids), bool)
    last[rng.integers(0, len(ids), 500)] = True
    last[-1] = True
    rules, symbols, mark = grammar.compress(ids, last, 1000)
    pairs = Counter((a, b) for a, b, m in zip(symbols.tolist(), symbols[1:].tolist(), mark.tolist()) if not m)

    def spell(s):
        return [s] if s < 1000 else spell(int(rules[s - 1000, 0])) + spell(int(rules[s - 1000, 1]))

    assert [x for s in symbols.tolist() for x in spell(s)] == ids.tolist()
    # overlapping occurrences of one symbol's pair count once for two
    assert all(n < 2 * grammar.RARE if a == b else n < grammar.RARE for (a, b), n in pairs.items())


def test_whole_license_texts_are_found(spark, make):
    mit, bsd = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["BSD-3-Clause-text"]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 60 != 30)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make(["Copyright 2020 X\n" + mit, "text before " * 300 + bsd + " and after" * 50, edited, " ".join(words[:60]), None])).collect()}
    assert "MIT-text" in got[0]["licenses"] and got[0]["best_containment"] == 1.0
    assert {"BSD-3-Clause-text", "BSD-2-Clause-text"} <= set(got[1]["licenses"].split(","))
    assert "MIT-text" in got[2]["licenses"] and "MIT-text" not in got[3]["licenses"].split(",")
    assert got[4]["n_licenses"] == 0


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "Mine").write_text("You may use this thing in any way that you like, but do not blame us for it.")
    scanner = licenses.LicenseScanner(licenses.load_templates(str(tmp_path)))
    assert scanner.scan([b"x you may use this thing in any way that you like but do not blame us for it"])[0] == {"Mine": 1.0}
