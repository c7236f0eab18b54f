"""Contracts and packs, metrics worked out by hand, and backends."""

import json

import pytest

from assaylake.operators import floors, plugins
from assaylake.operators.plugins import JudgeMetric

FINDING = "case_id long, code string, subject string, quote string, text string"


def findings(spark):
    return spark.createDataFrame(
        [
            (1, "a", "aspirin", "he takes aspirin daily", "He takes Aspirin - daily."),
            (1, "b", "aspirin", "nothing of that", "He takes Aspirin - daily."),
            (2, "a", "of at", "He takes aspirin daily", "x he takes aspirin, daily y"),
            (3, "a", "ibuprofen", "short", "He takes Aspirin."),
            (4, "c", "aspirin", None, None),
        ],
        FINDING,
    )


def test_the_first_contract_that_disproves(spark):
    declared = [("a", "presence", {}), ("a", "quoted", {}), ("b", "quoted", {}), ("b", "presence", {}), ("c", "presence", {})]
    got = sorted(map(tuple, plugins.disproved(findings(spark), declared).collect()))
    assert got == [(1, "a", "presence"), (1, "b", "presence"), (2, "a", "quoted"), (3, "a", None), (4, "c", None)]
    assert {r["contract"] for r in plugins.disproved(findings(spark), []).collect()} == {None}
    with pytest.raises(ValueError, match="no contract"):
        plugins.checked([("a", "unheard", {})])


def test_a_pack_brings_its_own(spark, tmp_path):
    before = plugins.contracts()
    (tmp_path / "own.py").write_text("def always(f, p):\n    return f.selectExpr('case_id', 'code', 'true as disproved')\nCONTRACTS = {'presence': always}\nFLOORS = {'own_floor': always}\n")
    (tmp_path / "pack.json").write_text(json.dumps({"floors": "own.py"}))
    (tmp_path / "bare.json").write_text("{}")
    try:
        assert plugins.load_pack(str(tmp_path / "bare.json")) == []
        assert plugins.load_pack(str(tmp_path / "pack.json")) == ["own_floor", "presence"]
        assert plugins.disproved(findings(spark), [("c", "presence", {})]).filter("contract is not null").count() == 1
        assert "own_floor" in floors.floors() and plugins.discover() == {}
    finally:
        plugins._CONTRACTS.update(before)


def test_metrics(spark):
    rows = spark.createDataFrame([("j", ["a", "x"], ["a"]), ("j", ["a"], ["a", "b"]), ("j", ["x"], ["x"]), ("j", None, None), ("j", ["b"], [])], "role string, expected array<string>, raised array<string>")
    (plain,) = JudgeMetric(("a", "b")).over(rows, ["role"]).collect()
    # exact, half a point off, a code of another judge, exact, missed
    assert (plain["tp"], plain["fp"], plain["fn"], plain["neutral"], plain["accepted"]) == (2, 2, 1, 0, False)
    assert plain["graded"] == round((1 + 2 / 3 + 0 + 1 + 0) / 5, 6) and (plain["precision"], plain["recall"]) == (0.5, 0.6667)
    (aware,) = JudgeMetric(("a", "b"), True).over(rows, ["role"]).collect()
    assert (aware["fp"], aware["neutral"]) == (1, 1) and aware["graded"] == round((1 + 2 / 3 + 1 + 1 + 0) / 5, 6)
    (whole,) = JudgeMetric().over(rows, ["role"]).collect()
    assert (whole["tp"], whole["fp"], whole["fn"]) == (3, 1, 2)


def test_a_backend_that_fails_gives_neutral_verdicts(spark):
    class Half(plugins.Backend):
        pin = plugins.Pin("half", "1")

        def evaluate(self, case):
            if case["case_id"] % 2:
                raise RuntimeError("down")
            return plugins.Verdict("BLOCK", "PASS", ["x"])

    got = {r["case_id"]: r for r in plugins.evaluated(spark.range(6).selectExpr("id as case_id"), Half).collect()}
    assert (got[2]["compliance"], got[2]["flags"], got[2]["error"], got[2]["backend"]) == ("BLOCK", ["x"], None, "half")
    assert (got[3]["compliance"], got[3]["flags"], got[3]["error"]) == ("NEUTRAL", [], "RuntimeError: down")
    assert plugins.evaluated(spark.range(0).selectExpr("id as case_id"), Half).count() == 0
