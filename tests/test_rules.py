"""Rules with values worked out by hand."""

import math

from pyspark.sql import functions as F

from assaylake.functions import records as fr
from assaylake.functions import text as t
from assaylake.operators import calibration, consensus, datagen, floors, history, kpi, reports, units
from assaylake.sources import stores


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values) or "x string").select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_stems_and_salience(spark):
    want = {"is": "is", "as": "as", "includes": "include", "storing": "stor", "red": "red", "boss": "boss", "cats": "cat", "used": "used", "asked": "ask", "sings": "sing", "ring": "ring"}
    got = {w: one(spark, t.stem(F.col("x")), x=w) for w in want}
    assert got == want
    assert sorted(one(spark, t.salient_stems(F.col("x")), x="The plan includes 20 GB, x7 and 100 extras; what about yours? x700s")) == sorted(["plan", "include", "20", "100", "extra", "about", "x700"])


def test_personal_data(spark):
    text = "Call 555-123-4567 or 5551234567, mail a.b@c.org, SSN 123-45-6789, MRN: 1234567, Policy #123456, ID 999999, 10.0.0.1, AA:BB:CC:DD:EE:FF, 4111 1111 1111 1111"
    n = {k: one(spark, t.matches(F.col("x"), k), x=text) for k in t.PII}
    assert n["phone"] == 2 and n["email"] == 1 and n["ssn"] == 1 and n["credit_card"] == 1 and n["mac_address"] == 1 and n["ip_address"] == 1
    assert n["insurance_number"] == 2 and n["medical_record"] == 0  # one separator at most before the number
    spans = one(spark, t.spans(F.col("x"), "phone"), x=text)
    assert [(s["value"], s["start"]) for s in spans] == [("555-123-4567", 5), ("5551234567", 21)]
    assert spans[0]["context"] == text[: 5 + 12 + 50]
    redacted = one(spark, t.redacted(F.col("x")), x="DOB: 1/2/1980, mrn ABC-1234, 12 Long Oak Street, 123-45-6789, a@b.co")
    assert redacted == "[REDACTED_DOB], [REDACTED_MRN], [REDACTED_ADDRESS], [REDACTED_SSN], [REDACTED_EMAIL]"


def test_personal_data_beside_letters_of_other_scripts(spark):
    """As SQL reads the patterns: words are ASCII, a vertical tab is no space, the long s and the Kelvin sign are s and k."""
    import duckdb

    texts = ["214 geieein. Stää zu", "202 des. Chtetz berpf er stß", "é123-45-6789ß", "ü555-123-4567ö und 5551234567é", "ña@b.coß", "äMRN: 123456", "MRN\x0b123456", "12 Long\x0bOak Street", "12 Long Oak \u017ft", "12 Oa\u212a Street"]
    texts += ["dob\x0b1/2/1980", "éborn on 1/2/1980", "patient id \u017f\u212aab1", "mrn é1234", "１２３-45-6789", "e\u0301 12 Oak Stu\u0301", "ID 999999é", "é10.0.0.1é", "ßAA:BB:CC:DD:EE:FFß", "DL\x0b1234567", "555\x0b123 4567", "4111 1111 1111 1111é", None, ""]
    sql = "x"
    for kind, pattern in t.REDACTIONS.items():
        sql = f"regexp_replace({sql}, '{pattern}', '[REDACTED_{kind.upper()}]', 'g')"
    counts = ", ".join(f"len(regexp_extract_all(x, '{p}'))" for p in t.PII.values())
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(t.redacted(F.col("x")), *[t.matches(F.col("x"), k) for k in t.PII], *[F.size(t.spans(F.col("x"), k)) for k in t.PII]).collect()
    for x, r in zip(texts, got):
        want = duckdb.execute(f"select {sql}, {counts} from (select cast(? as varchar) as x)", [x]).fetchone()
        assert (x, *r[: len(want)]) == (x, *want)
        assert x is None or r[len(want) :] == want[1:]


def test_head_and_tail_and_slug(spark):
    text = "a" * 1000 + "b" * 1001
    assert one(spark, t.head_and_tail(F.col("x")), x=text) == "a" * 800 + "\n...[truncated]...\n" + "b" * 800
    assert one(spark, t.head_and_tail(F.col("x")), x="a" * 2000) == "a" * 2000
    assert one(spark, t.title_slug(F.col("x")), x="  Case 7: chest__pain! ") == "CASE_7_CHEST_PAIN"


def test_prefix_sweep(spark):
    votes = [("a", run, v) for run, v in enumerate(["BLOCK", "PASS", "PASS"])] + [("b", run, v) for run, v in enumerate(["WARN", "WARN", "BLOCK"])] + [("c", 0, "WARN")]
    df = spark.createDataFrame(votes, "case_id string, run int, vote string").withColumn("role", F.lit("r"))
    got = {r["k"]: (r["cases"], r["flips"], r["converged"], r["mean_variance"]) for r in calibration.prefix_sweep(df, "r", 5).collect()}
    # a: BLOCK, tie, PASS against PASS; b: tie, tie, BLOCK against BLOCK; c: tie against a tie
    assert got == {1: (3, 2, 0, 0.0), 2: (2, 2, 0, 0.125), 3: (2, 0, 2, round((2 / 9 + 1 / 18) / 2, 6))}


def test_risk_and_score(spark):
    safety = spark.createDataFrame([("x", "pii", 0, True, "high", 0.9), ("x", "compliance", 1, True, "low", 0.5), ("x", "unsafe", 0, False, "high", 1.0), ("y", "unsafe", 0, True, "odd", 0.2)], "conv_id string, kind string, k int, hit boolean, severity string, confidence double")
    turns = spark.createDataFrame([("x", True, "high", 0.4, "t"), ("x", True, "low", 0.2, None), ("z", False, "high", 1.0, None)], "conv_id string, flagged boolean, severity string, confidence double, alert string")
    calls = spark.createDataFrame([("x",), ("y",), ("z",)], "conv_id string")
    got = {r["conv_id"]: (r["risk"], r["confidence"], r["alerts"]) for r in kpi.risk(calls, safety, turns).collect()}
    assert got == {"x": (0.9, round((0.9 + 0.5 + 0.3) / 3, 6), "compliance_violation_1,high_risk_pii,pii_leakage,t"), "y": (0.4, 0.2, "unsafe_response"), "z": (0.0, 0.0, "")}
    row = dict(conv_id="x", has_core=True, latency_ms=4000, interruptions=1, repetitions=2, silences=3, has_quality=False, intent_match=True, intent_confidence=1.0, hallucination=False, deviation=False, completed=True, completion_confidence=1.0)
    row |= dict(has_sentiment=True, user_mood="neutral", user_confidence=0.5, agent_mood="negative", frustration=True, escalation=False, has_technical=True, mos=None, audio=0.9, distorted=True, snr=15.0, tool_errors=1, processing_ms=40000, available=False)
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'double'}" for k, v in row.items())
    call = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row.values())], schema)
    r = kpi.overall(call, kpi.risk(call, safety, turns), safety).first()
    core, sentiment, technical = 100 - 10 - 5 - 6 - 6, 100 - 10 - 2.5 - 10 - 15, 90 - 15 - 10 - 5 - 5 - 15
    safe = 100 - 54 - 15 - 20
    assert (r["core"], r["quality"], r["sentiment"], r["safety"], r["technical"]) == (core, None, sentiment, safe, technical)
    assert r["score"] == round((0.2 * core + 0.15 * sentiment + 0.25 * safe + 0.15 * technical) / 0.75, 2)


def test_units_compare_quotes_in_pairs(spark):
    rows = [(1, "a", "f", [["x", "y"], ["p", "q", "r"]]), (1, "b", "f", [["u"], ["p", "q", "z", "w"]]), (1, "c", "f", [["x", "u", "p"]]), (1, "d", "g", [["x", "y"]]), (1, "e", "", [["x", "y"]])]
    codes = spark.createDataFrame(rows, "case_id long, code string, family string, quotes array<array<string>>")
    got = {r["code"]: r["unit"] for r in units.finding_units(codes, 5).collect()}
    # a and b share two of three words in a pair of quotes; b's quote "u" lies in c's; pooled, a and c would have met too
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert {(r["a"], r["b"]) for r in units.unit_edges(codes).collect()} == {("a", "b"), ("b", "c")}


FINDING = "case_id long, role string, code string, has_evidence boolean, tier int, pillar string, owner string"


def test_consensus(spark):
    votes = spark.createDataFrame(
        [(1, "faithfulness", "PASS", 0.9, True), (1, "policy", "WARN", None, True), (1, "risk", "PASS", 0.5, True)]
        + [(2, "faithfulness", "BLOCK", 0.9, True), (2, "risk", "BLOCK", 0.9, False)]
        + [(3, "faithfulness", "PASS", 0.9, True), (3, "policy", "PASS", 0.9, True), (3, "risk", "PASS", 0.9, True)]
        + [(4, "faithfulness", "PASS", 0.9, True), (4, "policy", "PASS", 0.9, True), (4, "risk", "PASS", 0.9, True)],
        "case_id long, role string, vote string, confidence double, usable boolean",
    )
    findings = spark.createDataFrame([(3, "policy", "privacy_leak", True, 1, "conversation", "policy"), (4, "policy", "format", True, 2, "artifact", "policy")], FINDING)
    got = {r["case_id"]: tuple(r)[1:] for r in consensus.consensus(votes, findings).collect()}
    assert got[1] == (3, 0, "PASS", 0.7, True, False, None)
    assert got[2] == (1, 0, "WARN", 0.0, False, True, "insufficient_valid_models")
    assert got[3] == (3, 0, "PASS", 0.9, True, False, None)  # raised by one judge alone, while the others pass: suppressed
    assert got[4] == (3, 0, "WARN", 0.9, True, False, None)  # the artifact's flag raises the verdict
    gate = {r["case_id"]: (r["verdict"], r["consensus"]) for r in consensus.consensus(votes, findings, gate_mode=True).collect()}
    assert gate[2] == ("BLOCK", True)


def test_mutants(spark):
    specs = spark.createDataFrame([("f", "enum", True, "", ["AB", "c"]), ("g", "datatype", False, "date", []), ("h", "enum", True, "", ["1"])], "field string, kind string, required boolean, datatype string, allowed array<string>")
    rows = spark.createDataFrame([(1,)], "k long")
    got = {(r["field"], r["op"]): (r["value"], r["expected"]) for r in datagen.mutation_battery(rows, "k", specs).collect()}
    assert got["f", "case_variant"] == ("ab", "BLOCK") and got["f", "near_miss"] == ("ABX", "BLOCK") and got["f", "null"] == (None, "BLOCK")
    assert got["g", "strip"] == ("<absent>", "PASS") and ("g", "null") not in got and got["g", "legal_prefix_then_junk"] == ("2026!!junk", "BLOCK")
    assert ("h", "case_variant") not in got
    valid = {(r["field"], r["value"]) for r in datagen.valid_variations(rows, "k", specs).collect()}
    assert valid == {("f", "c"), ("g", "2025-01-01"), ("g", "1999-12-31"), ("g", "<absent>")}


def test_floors(spark):
    hits = spark.createDataFrame([(1, 0.7, True), (1, 0.2, True), (2, None, None), (3, 0.4, False)], "case_id long, score double, corroborates boolean")
    as_map = lambda df: {r["case_id"]: r["conforms"] for r in df.collect()}
    assert as_map(floors.retrieval(hits, {})) == {1: True, 2: None, 3: False}
    assert as_map(floors.knowledge(hits, {"min_score": 0.3, "match": "claim_in_chunk"})) == {1: True, 2: None, 3: None}
    assert as_map(floors.knowledge(hits, {"min_score": 0.3, "expect": "absent"})) == {1: False, 2: None, 3: False}
    said = spark.createDataFrame([(1, "Agent", "user"), (1, "agent ", "user"), (1, "unknown", "user"), (2, "a", "a"), (2, None, "a"), (2, "a", "A")], "case_id long, source_speaker string, attributed string")
    assert as_map(floors.attribution(said, {})) == {1: False, 2: True}
    flags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "case_id long, code string")
    results = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", True)], "case_id long, code string, conforms boolean")
    routed = {r["case_id"]: (r["verdict"], r["cleared"], r["unresolved"]) for r in floors.route(flags, results).collect()}
    assert routed == {1: ("reject", 1, 1), 2: ("approve", 1, 0), 3: ("approve", 0, 0)}
    assert {"retrieval", "knowledge", "structure", "preserved", "attribution", "subsumption"} <= set(floors.floors())


def test_linked_chunks_take_the_first_match(spark):
    spans = spark.createDataFrame([(1, "s", "Has E11.9 and Plan here"), (1, "u", "Planning only")], "case_id long, span_id string, quote string")
    matches = spark.createDataFrame([(1, 0, "kb", "ab", "Pl"), (1, 1, "kb", "zzz", "Plan"), (1, 2, "kb", "E119", None)], "case_id long, place int, namespace string, code string, label string")
    assert {r["span_id"]: r["chunk_id"] for r in floors.linked_chunks(spans, matches).collect()} == {"s": "kb:Plan", "u": None}


def test_scalar_rules(spark):
    assert one(spark, fr.dose(F.col("x")), x="amoxicillin 250 MG / clav 62.5 MG") == "250 MG" and one(spark, fr.dose(F.col("x")), x="as is") == "as directed"
    assert one(spark, fr.without_suffix(F.col("x")), x="Abdul218") == "Abdul"
    assert one(spark, fr.case_number(F.col("x")), x="My Case_-012") == 0 and one(spark, fr.case_number(F.col("x")), x="Case-0012 x") == 12
    assert one(spark, fr.specialty(F.col("x")), x="Blood_Cancer and Kidney") == "nephrology"
    assert one(spark, fr.semantic_tag(F.col("x")), x="Asthma (Disorder) ") == "disorder" and one(spark, fr.semantic_tag(F.col("x")), x="Asthma") is None
    assert one(spark, fr.without_fence(F.col("x")), x="```yaml\na: 1\nb\n```") == "a: 1\nb" and one(spark, fr.without_fence(F.col("x")), x=" plain ") == "plain"
    assert one(spark, fr.without_sentences(F.col("x"), F.array(F.lit("Two.")))  , x="One. Two. Three!") == "One. Three!"
    assert one(spark, fr.without_sentences(F.col("x"), F.array(F.lit("Four."))), x="One. Two.") is None
    tokens = spark.createDataFrame([([("the", -1.0), ('"Reject"', -0.5), ("approve", -0.1)],), ([("x", -1.0)],), ([("needs", 0.2)],)], "t array<struct<token string, logprob double>>")
    assert [r[0] for r in tokens.select(fr.verdict_confidence(F.col("t"))).collect()] == [round(math.exp(-0.5), 6), None, 1.0]


def test_exact_percentiles(spark):
    rows = [("a", x) for x in (1.0, 2.5, 2.75, 9.0)] + [("b", 5.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in history.latency_percentiles(df, "k", "v").collect()}
    assert got == {"a": (4, 2.625, round(2.75 + 0.85 * 6.25, 6)), "b": (7, 5.0, 5.0)}


def test_bootstrap_of_equal_values_is_that_value(spark):
    r = reports.bootstrap(spark.range(40).withColumn("v", F.lit(0.25)), "id", "v", 20).first()
    assert tuple(r) == (0.25, 0.25, 20)


def test_uploads(spark):
    rows = [(1, '{"a": [1], "few": [{"y": "1"}], "rows": [{"x": "1"}, {"x": "2"}]}'), (2, '{"x": 1}\n\n{"x": 2}\n{"x'), (3, "x,y\n1,2\n3,4"), (4, '[{"x": "9"}]'), (5, '{"x": "7"}')]
    got = stores.decode_texts(spark.createDataFrame(rows, "id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["id"], r["kind"]), []).append(None if r["record"] is None else r["record"]["x"])
    assert by == {(1, "json"): ["1", "2"], (2, "jsonl"): ["1", "2", None], (3, "csv"): ["1", "3"], (4, "json"): ["9"], (5, "json"): ["7"]}


def test_unit_scores_derive_the_codes_once(spark, tmp_path):
    """Codes and units are read several times; what derives them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "case_id long, code string, family string, tokens array<string>"
    rows = [(1, "a", "x", ["p", "q"]), (1, "b", "x", ["p", "q"]), (1, "c", "", ["p"]), (2, "a", "x", None)]
    codes = spark.createDataFrame(rows, schema).mapInArrow(noted, schema)
    families = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "")], "code string, family string")
    gold = spark.createDataFrame([(1, "a"), (2, "c")], "case_id long, code string")
    r = units.unit_scores(units.finding_units(codes, 3), gold, families).first()
    assert (r["units"], r["tp"], r["gold"], r["caught"]) == (3, 1, 2, 1) and seen.value == len(rows)


def test_linked_chunks_of_cases_with_few_and_many_names(spark, monkeypatch):
    spans = spark.createDataFrame([(1, "s", "the Plan of E11.9 été"), (1, "t", None), (2, "u", "Plan B12"), (3, "v", "Plan")], "case_id long, span_id string, quote string")
    matches = spark.createDataFrame([(1, 0, "kb", "zz", "Nowhere"), (1, 1, "kb", "E119", "the"), (2, 0, "kb", "Plan", None), (2, 1, "kb", "B12", "Plan")], "case_id long, place int, namespace string, code string, label string")
    for many in (1000, 2, 0):
        monkeypatch.setattr(floors, "MANY", many)
        got = {r["span_id"]: r["chunk_id"] for r in floors.linked_chunks(spans, matches).collect()}
        assert got == {"s": "kb:E119", "t": None, "u": "kb:Plan", "v": None}
