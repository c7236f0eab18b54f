import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_follow_each_other(spark):
    import corpus_pipeline as c
    from assaylake.llm import ngram_join, quality, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    kept = []
    for _, stage in c.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
        now = spark.createDataFrame(now.collect(), docs.schema)
    good = {r["doc_id"] for r in quality.judge_quality(docs).filter("kept").collect()}
    assert set(kept[0]) == good
    assert set(kept[1]) <= good and set(kept[2]) == set(kept[1])
    scanner = secrets.Scanner()
    assert all(kept[2][i] == secrets.redact(t, scanner) for i, t in kept[1].items())
    packed = c.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(kept[2])


def test_near_duplicates_just_above_and_below_the_limit(spark, make):
    import corpus_pipeline as c

    words = lambda n, k: [f"w{k}x{i}" for i in range(n)]
    changed = lambda x: " ".join([*x[: len(x) // 2], "other", *x[len(x) // 2 + 1 :]])
    # n words have n - 4 shingles; one changed word in the middle leaves n - 9 of n + 1 in the union
    pairs = {n: words(n, n) for n in (48, 49, 52)}
    for n in pairs:
        shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (pairs[n], changed(pairs[n]).split())]
        similarity = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
        assert (similarity >= 0.8) == (n >= 49)
    docs = make([t for x in pairs.values() for t in (" ".join(x), changed(x))])
    assert sorted(r["doc_id"] for r in c.near_duplicates(spark, docs, SF).collect()) == [0, 1, 2, 4]


def test_sql_twins(spark):
    from assaylake.llm import entry

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, SF).select(*names).collect())
        assert got == sorted(tuple(map(str, r)) for r in want.fetchall()), name
