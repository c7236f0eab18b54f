import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import ann, graph, ngram_join, warc
from assaylake.llm.common import join_hot


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    found = graph.UnionFind()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                found.union(i, j)
    return {i: found.find(i) for i, _ in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("uvwxyz") + str(rng.randint(0, 40))
    shared = " ".join(word() for _ in range(30))
    base = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one", "One", "one two", "two words", "a b c d", "A b\tc D"]
    for _ in range(60):  # a chain of near copies, some beyond the limit
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = word()
        texts.append(" ".join(x))
    texts += [shared + " " + " ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [texts[20]] * 30
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, make, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(make(texts).repartition(3)).collect()}
    want = brute(list(enumerate(texts)))
    assert got == {i: (len(shingles(t)), want[i]) for i, t in enumerate(texts)}


def test_cells_lose_no_link(spark, make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 2000)
    monkeypatch.setattr(ngram_join, "TEXT", 1500)
    texts = corpus(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(make(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


@pytest.mark.parametrize("fragment", [300, 2000, 12 << 20])
def test_first_cut_counts_shingles_of_no_other_document(spark, make, monkeypatch, fragment):
    """At 50 the cut takes the whole order, so its counts are the true ones; at 85 they are at most that."""
    monkeypatch.setattr(ngram_join, "FRAGMENT", fragment)
    monkeypatch.setattr(ngram_join, "TEXT", 700)
    texts = corpus(5)
    sets = [shingles(t) for t in texts]
    held = Counter(x for s in sets for x in s)
    want = {i: (len(s), sum(held[x] == 1 for x in s)) for i, s in enumerate(sets)}
    docs = make(texts).repartition(4)
    count = lambda percent: {r["doc_id"]: (r["n_shingles"], r["lone"]) for r in ngram_join.count_lone(docs, 4, percent).collect()}
    assert count(50) == want
    part = count(85)
    assert {i: n for i, (n, _) in part.items()} == {i: n for i, (n, _) in want.items()}
    assert all(lone <= want[i][1] for i, (_, lone) in part.items())
    assert 0.25 < sum(x for _, x in part.values()) / sum(x for _, x in want.values()) < 0.5


def test_rows_of_the_first_cut_follow_the_text(spark, make, monkeypatch):
    """Four times the text in four times the blocks: the rows of a block are its coarse fragments, those of a gathering the fine ones."""
    monkeypatch.setattr(ngram_join, "TEXT", 700)
    docs = ngram_join._prepare(make(corpus(5)).repartition(4))
    side = 5
    coarse = ngram_join._coarse(docs, 4, 85, side, 6)
    blocks = coarse.select("block").distinct().count()
    assert blocks > 20 and coarse.count() <= blocks * (side + 1)
    fine = coarse.filter("fragment >= 0").groupBy("fragment", "gather").applyInArrow(ngram_join._finer(side), ngram_join._CUT)
    assert 0 < fine.count() <= 6 * side * side
    size = lambda x: x.filter("fragment >= 0").agg(F.sum(F.octet_length("low"))).first()[0]
    assert size(fine) == size(coarse)


def test_links_beside_hubs_are_found(spark, make, monkeypatch):
    """Chains: each text is near the next only, so hubs alone do not connect them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(8)
    texts = []
    for c in range(6):
        x = [f"c{c}w{i}" for i in range(120)]
        for _ in range(12):
            at = rng.randrange(110)
            x = x[:at] + [f"n{rng.random()}"] + x[at + 1 :]
            texts.append(" ".join(x))
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(make(texts)).collect()}
    want = brute(list(enumerate(texts)))
    assert got == want and len(set(want.values())) < len(texts) / 2


def test_join_edges(spark, make):
    assert ngram_join.join_documents(make(["x"]).filter("false")).count() == 0
    got = ngram_join.join_documents(make(["a b c d e", "a b c d e", None], [5, 3, None])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got)[1:] == [(3, 2, 3), (5, 2, 3)]
    twice = ngram_join.join_documents(make(["a b c d e", "a b c d e"], [4, 4])).collect()
    assert [(r["doc_id"], r["component_id"]) for r in twice] == [(4, 4), (4, 4)]


def test_one_of_each_group_stays(spark, make):
    texts = corpus(4)
    docs = make(texts)
    kept = ngram_join.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(list(enumerate(texts))).values()))


def test_partial_overlaps_of_long_sets(spark):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2)) for _ in range(4)]
    sets.append(np.unique(np.append(sets[0][:-200], rng.integers(0, 2**63, 100, dtype=np.uint64))))
    rows = [(i, i, len(x), bytearray(x.astype("<u8").tobytes())) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, doc_id long, n long, shingles binary")
    pairs = spark.createDataFrame([(i, i, len(sets[i]), j, j, len(sets[j])) for i in range(5) for j in range(i)], ", ".join(f"{c} long" for c in ngram_join.PAIR))
    got = {(r["a"], r["b"]) for r in ngram_join._links(pairs, ngram_join._segments(table), 85).collect()}
    near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    assert got == {(i, j) for i in range(5) for j in range(i) if near(sets[i], sets[j])} == {(4, 0)}


def test_repeated_ids_with_other_texts_are_one_node(spark, make):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = make([a, a + " x", b, b + " y", a, None, ""], [9, 5, 5, 7, 9, 7, 3])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect())
    assert got == [(3, 0, 3), (5, 57, 5), (5, 58, 5), (7, 0, 5), (7, 58, 5), (9, 57, 5), (9, 57, 5)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 50)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (130, 130), (130, 131)]
    found = graph.UnionFind()
    for a, b in edges:
        if a != b:
            found.union(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: found.find(x) for e in edges for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def nearest(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scores = sorted((-(q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())), j) for j, v in good if j != i)
            out[i] = [j for _, j in scores[:k]]
    return out


def test_search_is_exact_on_one_part(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(90)]
    rows += [(200, [1.0] * 8, 0), (201, [1.0] * 8, 0), (202, [1.0] * 8, 0), (203, [0.0] * 8, 0), (204, None, 0), (205, [float("nan")] * 8, 0), (206, [None] * 8, 0), (None, [1.0] * 8, 0), (250, [float("inf")] + [1.0] * 7, 0)]
    got = {}
    for r in ann.search(vectors(spark, rows), every=50, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest([x[:2] for x in rows], 50, 5)
    assert ann.search(vectors(spark, [(50, [1.0, 0.0], 0), (51, [1.0, 0.0], 0)])).count() == 1
    assert ann.search(vectors(spark, [])).count() == 0


def test_search_recall_and_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 2
    rows = [(i, (centres[i % 20] + rng.standard_normal(16)).tolist(), 0) for i in range(1500)]
    got = {}
    for r in ann.search(vectors(spark, rows), every=50, k=5, plan=ann.Plan(parts=8, sample=800, block=100)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = nearest([x[:2] for x in rows], 50, 5)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(6)
    x = ann.unit(rng.standard_normal((400, 8)))
    label = ann.balanced_parts(ann.nearest(x, x, 6), 8)
    assert np.bincount(label, minlength=8).tolist() == [50] * 8


PAGES = "page_id long, url string, html string"


def test_archive(spark, tmp_path):
    rows = [(1, "u1", "same é"), (2, "u2", "same é"), (3, None, None), (4, "u4", ""), (5, "u5", "other"), (None, "n", "same é"), (5, "u5", "other")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("owner", F.lit(1)).withColumn("digest", F.lit("x"))
    folder = f"file://{tmp_path}/warc"
    warc.write_archive(pages, folder)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_index(spark, folder).collect()), key=str)
    assert got == sorted([(-1, 7, "revisit", 2), (1, 7, "revisit", 2), (2, 7, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 5, "response", None), (5, 5, "revisit", 5)], key=str)
    assert warc.read_payloads(spark, folder).count() == 3
    records = [bytes(r["record"]) for r in warc.read_archive(spark, folder).collect()]
    assert len(records) == 7
    for x in records:
        head, _, body = x.partition(b"\r\n\r\n")
        length = int(next(line.split(b": ")[1] for line in head.split(b"\r\n") if line.startswith(b"Content-Length")))
        assert head.startswith(b"WARC/1.1\r\n") and body[length:] == b"\r\n\r\n"
    assert sum("same é".encode() in x for x in records) == 1


def test_archive_digest_and_damage(spark, tmp_path):
    import base64
    import hashlib

    got = warc.archive_round_trip(spark.createDataFrame([(1, "u", "x<p>")], PAGES)).first()
    assert got["payload_digest"] == base64.b32encode(hashlib.sha1(b"x<p>").digest()).decode()
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0
    folder = f"file://{tmp_path}/bad"
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], PAGES), folder)
    spark.createDataFrame([("0" * 64, b"y")], "address string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_payloads(spark, folder).collect()


def test_small_payloads_stand_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/small"
    warc.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long text"), (4, "u", "long text")], PAGES), folder, least_bytes=5)
    got = sorted((r["page_id"], r["record_type"]) for r in warc.archive_index(spark, folder).collect())
    assert got == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


@pytest.mark.parametrize("size", [10, 5000])
def test_join_of_hot_keys_is_the_plain_join(spark, size):
    rows = spark.range(size).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id").unionByName(spark.range(size).select("id", "id").toDF("k", "id"))
    once = rows.groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("k <> 2")
    got = join_hot(rows, once, "k", "n", rows.count())
    assert got.columns == ["k", "id", "least"]
    want = rows.join(once.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_components_of_a_star_and_a_chain(spark):
    star = [(i, 500) for i in range(1000, 4000)] + [(500, 7)]
    chain = [(i, i + 1) for i in range(10_000, 10_040)]
    edges = spark.createDataFrame(star + chain + [(5, 5)], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 7 for i in [7, 500, *range(1000, 4000)]} | {i: 10_000 for i in range(10_000, 10_041)}


def test_archive_keeps_each_url_of_repeated_rows(spark, tmp_path):
    folder = str(tmp_path / "w")
    rows = [(7, "http://b", "same"), (7, "http://a", "same"), (7, "http://c", "same"), (7, "http://c", "same"), (3, "http://d", "same")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), folder)
    heads = [(r["page_id"], r["record_type"], r["refers_to"], bytes(r["header"]).decode().split("WARC-Target-URI: ")[1].split("\r")[0]) for r in warc.read_headers(spark, folder).collect()]
    revisits = [(7, "revisit", 7, f"http://{x}") for x in "bcc"] + [(3, "revisit", 7, "http://d")]
    assert sorted(heads, key=str) == sorted([(7, "response", None, "http://a"), *revisits], key=str)
    assert warc.read_archive(spark, folder).count() == len(rows)


def test_records_without_a_page_id(spark, tmp_path):
    rows = [(None, "b", "x"), (None, "a", "x"), (None, "a", "x"), (None, "c", "y"), (4, "d", "y"), (None, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = str(tmp_path / "w")
    warc.write_archive(pages, folder)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_index(spark, folder).collect()), key=str)
    assert got == sorted([(None, 1, "response", None), (None, 1, "revisit", None), (None, 1, "revisit", None), (None, 1, "revisit", 4), (4, 1, "response", None), (None, 0, "response", None)], key=str)
    for extra in ("owner", "digest", "shared", "share", "address"):
        pages = pages.withColumn(extra, F.lit("clash"))
    assert warc.archive_round_trip(pages).count() == len(rows)


def test_dates_are_in_utc(spark, tmp_path):
    from datetime import datetime, timezone

    folder, zone = str(tmp_path / "w"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        warc.write_archive(spark.createDataFrame([(1, "u", "x")], PAGES), folder)
        head = bytes(warc.read_headers(spark, folder).first()["header"]).decode()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    said = datetime.strptime(head.split("WARC-Date: ")[1].split("\r")[0], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    assert abs((datetime.now(timezone.utc) - said).total_seconds()) < 300


def test_an_address_that_holds_most_responses(spark, tmp_path):
    """Payloads below the least size aren't shared: one address, many responses, each with its body."""
    folder = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([(i, "u", "ab" if i % 3 else f"p{i}") for i in range(3000)], PAGES), folder, least_bytes=100)
    records = {r["page_id"]: bytes(r["record"]).split(b"\r\n\r\n")[1].decode() for r in warc.read_archive(spark, folder).collect()}
    assert records == {i: "ab" if i % 3 else f"p{i}" for i in range(3000)}


def test_vectors_of_any_magnitude(spark):
    """Scaling a vector by a power of two changes neither neighbours nor scores."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 16))
    power = np.array([0, -660, 600, 1000, -1000, 5])[np.arange(120) % 6]
    df = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "vec_id long, embedding array<double>").withColumn("part", F.lit("clash")).withColumn("rank", F.lit("clash"))
    plain, far = (sorted(map(tuple, ann.search(df(m), every=10).collect())) for m in (x, np.ldexp(x, power[:, None])))
    assert plain == far and len(plain) == 60
    from fractions import Fraction

    tiny = {50: [1e-200, 2e-200], 51: [2e180, 1e180], 52: [1e-320, 3e-320], 53: [-1.0, 0.5]}
    for q, _, v, score in ann.search(spark.createDataFrame(list(tiny.items()), "vec_id long, embedding array<double>")).collect():
        a, b = ([Fraction(c) for c in tiny[k]] for k in (q, v))
        dot = lambda p, r: sum(m * n for m, n in zip(p, r))
        want = float(dot(a, b) ** 2 / (dot(a, a) * dot(b, b))) ** 0.5 * (1 if dot(a, b) >= 0 else -1)
        assert abs(score - want) < 1e-12
