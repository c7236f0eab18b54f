import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assaylake.llm import licenses, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def texts():
    rng = random.Random(8)
    made = ["".join(rng.choice("ab \n\t#|é日\x85") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    prose = [" ".join(rng.choice("the of and to in a river stone walks under green light".split()) for _ in range(rng.randint(40, 200))) for _ in range(30)]
    junk = ["#$%* " * 150, "@@@@ !!!! " * 120]
    return made + prose + junk + [None, "", "x y z x y z", "a\na\n\n \n \na", "a " * 4000]


def test_counts_match_brute_force(spark, make):
    made = texts()
    got = {r["doc_id"]: r for r in quality.judge_quality(make(made)).collect()}
    for i, t in enumerate(made):
        want = base(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        fails = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == fails and not (fails and got[i]["kept"])


def test_divergence_drops_junk_and_keeps_prose(spark, make):
    rng = random.Random(9)
    common = "the of and to in a is that".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(200)) for _ in range(30)]
    marks = [" ".join(word() + rng.choice(["***", "$$$", "%%%"]) for _ in range(150)) for _ in range(2)]
    got = {r["doc_id"]: r for r in quality.judge_quality(make(clean + marks)).collect()}
    assert all(got[i]["kept"] for i in range(30))
    assert not got[30]["kept"] and not got[31]["kept"] and not got[30]["base_failed"]
    docs = make(clean + marks)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(30))


def test_texts_without_common_words_go_at_all_lengths(spark, make):
    rng = random.Random(10)
    common = "the of and to in a is that for was on be with as by at".split()
    rare = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(4, 8)))
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rare() for _ in range(n)) + "."
    clean = [prose(rng.choice([60, 90, 150, 400])) for _ in range(80)]
    menus = [" | ".join(rare().capitalize() + "." for _ in range(n)) for n in (40, 60, 120, 300)]
    marks = [" ".join(rare() + rng.choice(["***", "$$$"]) for _ in range(n)) for n in (60, 200)]
    lists = [" ".join(rare() for _ in range(n)) for n in (80, 200, 500)]
    made = clean + menus + marks + lists
    docs = make(made)
    got = {r["doc_id"]: r for r in quality.judge_quality(docs).collect()}
    assert all(got[i]["kept"] for i in range(80))
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i in range(80, len(made)))
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == set(range(80))


def test_a_language_of_few_words_is_held_against_all(spark, make):
    rng = random.Random(12)
    word = lambda: rng.choice("the of and to in a is".split()) if rng.random() < 0.4 else "".join(rng.choice("aeioubcdl") for _ in range(6))
    clean = [" ".join(word() for _ in range(200)) for _ in range(20)]
    menu = make([" | ".join("".join(rng.choice("aeioubcdl") for _ in range(6)) for _ in range(200))], ids=[99], lang="xx")
    got = {r["doc_id"]: r for r in quality.judge_quality(make(clean).unionByName(menu)).collect()}
    assert not got[99]["kept"] and sum(r["kept"] for r in got.values()) == 20


def test_distance():
    p, q = np.array([3, 1, 0]), np.array([1, 1, 2])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert abs(quality.distance(p, q) - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12
    assert quality.distance(p, p) == 0 and quality.distance(np.array([1, 0]), np.array([0, 1])) == 1
    assert quality.distance(np.zeros(2), p[:2]) == 0


def test_unknown_language_and_empty_table(spark, make):
    assert quality.judge_quality(make(["x"]).filter("false")).count() == 0
    assert quality.judge_quality(make(["the of " * 100, None], lang=None)).count() == 2


def brute_licenses(text):
    words = licenses.words_of((text or "").encode())
    own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    out = set()
    for name, t in licenses.TEMPLATES.items():
        w = licenses.words_of(t.encode())
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(want & own) / len(want) >= 0.8:
            out.add(name)
    return out


def test_licenses_match_containment(spark, make):
    rng = random.Random(11)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(n))
    made = [None, "", "mit", "Released under the MIT License"]
    for t in licenses.TEMPLATES.values():
        words = t.split()
        broken = list(words)
        broken[len(words) // 2] = "zzz"
        made += [t, filler(rng.randint(0, 300)) + " " + t.upper() + "\n" + filler(rng.randint(0, 300)), filler(50) + " ".join(broken) + filler(9), " ".join(words[: len(words) // 2])]
    made.append(" ".join([filler(2000), licenses.TEMPLATES["MIT-text"], filler(2000), licenses.TEMPLATES["Apache-2.0"]]))
    made += [made[4]] * 3
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make(made)).collect()}
    for i, t in enumerate(made):
        assert set(filter(None, got[i]["licenses"].split(","))) == brute_licenses(t), t
        assert got[i]["n_licenses"] == len(brute_licenses(t))


def test_bands_are_enough():
    assert max(licenses.miss_probability(licenses.least_similarity(n)) for n in range(1, 300)) < 2e-5
    with pytest.raises(ValueError):
        licenses.LicenseScanner({"short": "too few words"})
