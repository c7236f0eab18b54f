"""Chat formatting, Merkle manifest and ball k-means against plain versions, with their defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import balls, chat, merkle
from assaylake.llm.common import shared_folder

H = lambda t: hashlib.sha256(t.encode()).hexdigest()
TURNS = "conv_id long, turn long, role string, text string"


# chat


def parse(text):
    """The grammar, by a plain walk: role and text of each turn."""
    out = []
    while text:
        head = re.match(r"### ([^:]*): ", text)
        end = text.index("\n</turn>\n", head.end())
        label = head[1]
        out.append((label.lower() if label in chat.LABELS.values() else label, re.sub(r"\\(### |</turn>)", r"\1", text[head.end() : end])))
        text = text[end + 9 :]
    return out


def nasty(rng):
    parts = ["### ", "</turn>", "\n</turn>\n", "\\", "\\\\", "### Assistant: ", "#", " ", "\n", "x", "é漢😀", "</turn", ">", "", "\r", "### @a%20b: "]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(9)))


def digests(turns):
    said = [t or "" for r, t in turns if r == "assistant"]
    return len(turns), H("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len("".join(said)), H("".join(said))


def test_any_text_comes_back(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), nasty(rng)) for c in range(400) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    folder = shared_folder(spark, "chat")
    chat.write_conversations(df, folder)
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    written = {r["conv_id"]: r for r in spark.read.schema(chat.OUTPUT).parquet(folder).collect()}
    assert set(written) == set(want)
    for c, turns in want.items():
        text = written[c]["formatted"]
        assert parse(text) == turns
        raw = text.encode()
        masked = [raw[s["start"] : s["start"] + s["bytes"]].decode() for s in written[c]["loss"]]
        assert [re.sub(r"\\(### |</turn>)", r"\1", m) for m in masked] == [t for r, t in turns if r == "assistant"]
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_digests(spark, folder).collect()}
    assert got == {c: (*digests(t), len(written[c]["formatted"])) for c, t in want.items()}


def test_texts_without_conflict_stand_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "a ### b </turn> c"), (1, 1, "assistant", r"\### x")], TURNS)
    (row,) = chat.conversations_of(df).collect()
    assert row["formatted"] == "### User: a ### b </turn> c\n</turn>\n### Assistant: " + r"\\### x" + "\n</turn>\n"


def test_defined_cases_of_conversations(spark):
    long = "\\" * 300_000 + "### " * 100_000 + "\n</turn>\n" * 50_000
    rows = [
        (None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, "assistant", "twice"), (1, 3, "assistant", "twice"),
        (2, 0, "Assis:tant\n### ", "odd role"), (2, 1, "assistant", ""), (2, 2, "@user", "at"), (2, 3, "", "none"), (3, 0, "assistant", long),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("place", F.lit("clash")).withColumn("formatted", F.lit(1)).withColumn("size", F.lit(1)).repartition(3)
    got = sorted((tuple(r)[:-1] for r in chat.format_round_trip(df).collect()), key=str)
    turns = [(None, [("user", "a")]), (None, [("user", "a")]), (1, [("user", "first"), (None, None), ("assistant", "twice"), ("assistant", "twice")])]
    turns += [(2, [(r[2], r[3]) for r in rows if r[0] == 2]), (3, [("assistant", long)])]
    assert got == sorted(((c, *digests(t)) for c, t in turns), key=str)
    assert chat.format_round_trip(df.filter("false")).count() == 0


def test_the_added_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    (row,) = chat.format_round_trip(chat.with_conflict(empty)).collect()
    text = r"\### Assistant: </turn> ok"
    assert tuple(row) == (-7, *digests([("user", text), ("assistant", text)]), len("### User: ### Assistant: ") + 2 * (len(text) + 2 + 9))


def test_no_python_in_the_plan(spark):
    df = chat.with_conflict(spark.createDataFrame([], TURNS))
    folder = shared_folder(spark, "chat")
    chat.write_conversations(spark.range(1).selectExpr("id conv_id", "id turn", "'user' role", "'x' text"), folder)
    for plan in (chat.conversations_of(df.filter("conv_id < 0")), chat.read_digests(spark, folder)):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())


# Merkle


def collapse(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, k):
    out = []
    for level in levels[:-1]:
        first = k - k % 8
        out.append((level[first:k], level[k + 1 : first + 8]))
        k //= 8
    return out


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, lang, source, n, text: H("".join(map(field, (d, source, lang, n, text))))
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    trees = {}
    for d, text, lang, source, n in rows:
        mine = leaf(d, lang, source, n, text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        trees.setdefault(lang, []).append((d is not None, d or 0, mine, leaf(d, lang, source, n, lower(text)) if hit else mine, d))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {t: collapse([x[2] for x in sorted(trees[t])]) for t in order}
    top = collapse([low[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, x in enumerate(sorted(trees[t])):
            path = path_of(low[t], i) + path_of(top, k)
            node = x[3]
            for left, right in path:
                node = H("".join([*left, node, *right]))
            out.append((x[4], x[2], low[t][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1,), (7, 8, 9), (63, 64, 65), (513, 2, 512), (4097,), (1,) * 10])
def test_trees_of_any_size(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i * 7 + s, rng.choice(["Some Text", "plain", "É A"]) + str(i), f"l{s}", "s", i) for s, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str) == manifest(rows)


def test_defined_cases_of_documents(spark):
    rows = [(1, "A", "en", "s", 1)] * 40 + [(None, "A", "en", None, 1), (None, None, None, None, None), (None, None, None, None, None), (2, "", "", "", 0), (3, "Z" * 1_000_000 + "é", "é", "s", 5), (1, "B", "en", "s", 1), (5, "x", "ž", "-", -3)]
    rows += [(i, "Abc", None, "s", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("tree", "key", "digest", "row", "place", "n", "block", "path"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted((tuple(r) for r in merkle.manifest(df.repartition(3)).collect()), key=str) == manifest(rows)
    assert merkle.manifest(df.filter("false")).count() == 0


# balls


def k_means(vectors, plan=balls.Plan()):
    """All distances by Python's integers."""
    def whole(x):
        return int(x) * plan.scale if abs(x) >= 1 << 53 else math.floor(plan.scale * x)

    rows = [(i, [whole(float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == plan.components and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((H(f"{plan.seed}:{i}"), x) for i, x in rows if i is not None)
    centres = [x for _, x in named[: plan.clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))
    for _ in range(plan.rounds):
        of = [near(x)[1] for _, x in rows]
        centres = [[sum(m) // len(mine) for m in zip(*mine)] if (mine := [x for (_, x), o in zip(rows, of) if o == k]) else c for k, c in enumerate(centres)]
    last = [near(x) for _, x in rows]
    long = lambda n: n if n is not None and n < 1 << 63 else None
    total = lambda ds: long(None if any(d >= 1 << 63 for d in ds) else sum(ds))
    return sorted(((i, k, long(d), total([e for e, o in last if o == k]), total([e for e, _ in last]), H(",".join(map(str, centres[k])))) for (i, _), (d, k) in zip(rows, last)), key=str)


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("home", F.lit("clash")).withColumn("distance", F.lit("clash")).repartition(3)


def found(df, plan=balls.Plan()):
    return sorted((tuple(r) for r in balls.cluster_digests(df, plan).collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_are_those_of_all_distances(spark, spread):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 64))
    rows = [(i, [float(v) for v in centre[i % 6] + spread * rng.normal(size=64)]) for i in range(300)]
    df = table(spark, rows)
    assert found(df) == k_means(rows)
    taken = balls.cluster(df).taken
    assert all(t <= 8 * 300 for t in taken)
    if spread < 1:  # members of balls far apart are compared with few
        assert taken[-1] < 3 * 300


def test_ties_go_to_the_smaller_cluster(spark):
    plan = balls.Plan(clusters=4, rounds=5, components=2, scale=1)
    rows = [(i, [float(i % 7 - 3), float(i // 7 % 5)]) for i in range(140)]
    assert found(table(spark, rows), plan) == k_means(rows, plan)


def test_defined_cases_of_vectors(spark):
    rng = random.Random(1)
    vec = lambda f=1.0: [f * (rng.random() - 0.5) for _ in range(64)]
    rows = [(i, vec()) for i in range(30)] + [(5, vec()), (5, vec()), (None, vec()), (None, vec()), (40, None), (41, []), (42, vec() + [0.0]), (43, vec()[:63] + [float("nan")]), (44, vec()[:63] + [float("inf")]), (45, [None] + vec()[:63]), (46, [0.0] * 64)]
    same = vec()
    rows += [(50, same)] * 5 + [(51, same)]
    assert found(table(spark, rows)) == k_means(rows)
    large = rows + [(60, vec(1e9)), (61, vec(1e30)), (62, vec(1e300)), (63, [1.7e308] * 64), (64, vec(1e-200))]
    assert found(table(spark, large)) == k_means(large)
    few = rows[:3]
    assert found(table(spark, few)) == k_means(few)
    assert found(table(spark, rows).filter("false")) == []
    assert found(table(spark, [(None, vec())])) == []


def test_float_vectors_and_parts_that_move(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=64) * 0.2]) for i in range(200)]
    assert found(table(spark, rows, "float")) == k_means(rows)
    plan = balls.Plan(moved=1000)
    assert found(table(spark, rows, "float"), plan) == k_means(rows, plan)
