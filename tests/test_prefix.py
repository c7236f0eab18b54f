"""Numbers and runs of keys of any size against plain loops, and that a hot key's rows are dealt over tasks."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from assaylake.operators import prefix
from assaylake.shared import Scratch

ROWS = "k string, seq long, v string, ts long"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for k, n in (("hot", 3000), ("a", 40), ("b", 1), (None, 25)):
        seqs = rng.sample(range(10_000), n)
        rows += [(k, q, rng.choice(["x", "x", "x", "y", None]) if k != "a" else "same", q * 3) for q in seqs]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def log(spark, data):
    return spark.createDataFrame(data, ROWS).repartition(5)


def by_key(data):
    order = lambda r: (r[0] is None, r[0] or "", r[1])
    return {k: list(g) for k, g in groupby(sorted(data, key=order), key=lambda r: r[0])}


def test_versions_and_first_writes(log, data):
    want, made = [], []
    for k, rows in by_key(data).items():
        for i, r in enumerate(rows):
            want.append((*r, i + 1, "current" if i + 1 == len(rows) else "superseded"))
            made.append((*r, i + 1, rows[0][3]))
    assert sorted(map(tuple, prefix.versions(log, ["k"], "seq").collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, prefix.first_created(log, ["k"], "seq").collect()), key=str) == sorted(made, key=str)


def test_segments(log, data):
    want = []
    for k, rows in by_key(data).items():
        for i, (v, run) in enumerate(groupby(rows, key=lambda r: r[2])):
            run = list(run)
            want.append((k, i + 1, v, run[0][1], run[-1][1], len(run)))
    got = prefix.segments(log, "k", "v", ["seq"])
    assert got.columns == ["k", "segment", "v", "start", "end", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hot_key_uses_all_tasks(spark, log):
    scratch = Scratch(spark, "test")
    sizes = {r["_range"]: r["count"] for r in prefix._ranged(scratch, log.filter("k = 'hot'"), ["k"], ["seq"]).groupBy("_range").count().collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 2 * 3000 / 4
    scratch.discard()


def test_empty_and_clashing_columns(log):
    assert prefix.versions(log.filter("false"), ["k"], "seq").count() == 0 and prefix.segments(log.filter("false"), "k", "v", ["seq"]).count() == 0
    more = log.withColumn("n", F.lit(1)).withColumn("start", F.lit(2)).withColumn("segment", F.lit(3))
    assert prefix.segments(more, "k", "v", ["seq"]).count() == prefix.segments(log, "k", "v", ["seq"]).count()
