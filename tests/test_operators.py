from pyspark.sql import functions as F

from assaylake.functions import stats, text
from assaylake.functions.hashing import hash32, seed31, uniform
from assaylake.operators import agreement, calibration, consensus, datagen, hierarchy, history, prefix, rollup, scorecard, units

FINDING = "case_id long, role string, code string, tier int, pillar string, owner string, has_evidence boolean, severity string, gradeable boolean"
VOTE = "case_id long, role string, run int, gold_block boolean, vote string, confidence double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def finding(role, code="x", tier=1, evidence=True, owner="", case=1, pillar="dual"):
    return (case, role, code, tier, pillar, owner, evidence, "HIGH", True)


def tier_state(spark, *f):
    return consensus.code_tiers(spark.createDataFrame(list(f), FINDING)).first()["state"]


def test_tier_rules(spark):
    assert tier_state(spark, finding("a"), finding("b")) == "triggered"
    assert tier_state(spark, finding("a"), finding("b", evidence=False)) == "flagged"
    assert tier_state(spark, finding("a")) == "triggered"
    assert tier_state(spark, finding("a", owner="a")) == "triggered"
    assert tier_state(spark, finding("a", owner="b")) == "flagged"
    assert tier_state(spark, finding("a", evidence=False)) == "flagged"
    assert tier_state(spark, finding("a", tier=2), finding("b", tier=2)) == "triggered"
    assert tier_state(spark, finding("a", tier=2)) == "flagged"
    assert tier_state(spark, finding("a", tier=3)) == "listed"
    assert tier_state(spark, finding("a", tier=3), finding("b", tier=3, evidence=False)) == "corroborated"
    assert tier_state(spark, finding("a", evidence=False), finding("a")) == "triggered"  # any of a judge's findings may hold the evidence


def test_pillars(spark):
    t = consensus.code_tiers(spark.createDataFrame([finding("a", pillar="artifact"), finding("a", code="y", tier=2, pillar="dual")], FINDING))
    assert rows(consensus.pillar_verdicts(t), "pillar", "verdict") == [("artifact", "BLOCK"), ("conversation", "WARN")]


def votes(spark, *v):
    return spark.createDataFrame([(1, role, run, gold, vote, conf) for role, run, gold, vote, conf in v], VOTE)


def test_consensus_needs_two_judges(spark):
    none = spark.createDataFrame([], FINDING)
    one = consensus.consensus(votes(spark, ("faithfulness", 0, True, "BLOCK", None)), none).first()
    assert (one["verdict"], one["confidence"], one["consensus"]) == ("WARN", 0.0, False)
    cleared = consensus.consensus(votes(spark, ("faithfulness", 0, False, "PASS", None), ("risk", 0, False, "WARN", 0.9)), none).first()
    assert cleared["verdict"] == "PASS"
    worst = consensus.consensus(votes(spark, ("faithfulness", 0, False, "PASS", None), ("risk", 0, False, "BLOCK", 0.9)), none).first()
    assert worst["verdict"] == "BLOCK"


def test_withstands_passes_a_judge_without_findings(spark):
    v = votes(spark, ("risk", 0, True, "BLOCK", 0.9), ("policy", 0, True, "BLOCK", 0.9))
    f = spark.createDataFrame([finding("risk"), finding("policy", code="y")], FINDING)
    gone = spark.createDataFrame([(1, "x")], "case_id long, code string")
    lens = spark.createDataFrame([("risk", "x"), ("policy", "y")], "role string, code string")
    assert rows(consensus.withstands(v, f, gone, lens), "role", "decision") == [("policy", "BLOCK"), ("risk", "PASS")]


def test_mode_ties_go_to_the_first_seen(spark):
    v = votes(spark, *[("risk", i, False, x, 0.5) for i, x in enumerate(["WARN", "PASS", "PASS", "WARN"])])
    assert rollup.mode_by_first_seen(v, ["case_id"], "vote", "run").first()["modal"] == "WARN"


def test_kappa_edges(spark):
    same = votes(spark, ("a", 0, True, "PASS", 0.5), ("b", 0, True, "PASS", 0.5))
    k = agreement.fleiss_kappa(same, ["case_id"], "vote").first()
    assert k["kappa"] is None and k["insufficient"]
    raw = agreement.fleiss_kappa(same, ["case_id"], "vote", guarded=False).first()
    assert raw["kappa"] == 1.0
    c = agreement.cohen_kappa(spark.createDataFrame([("a", True, True)] * 3, "r string, p boolean, g boolean"), "p", "g", ["r"]).first()
    assert c["kappa"] is None and c["insufficient"]


def test_phi_is_null_on_an_empty_margin(spark):
    v = votes(spark, *[(r, i, True, "BLOCK", 0.5) for r in ("a", "b") for i in range(3)])
    assert agreement.pairwise_phi(v).first()["phi"] is None
    assert agreement.effective_votes(v).first()["n_eff"] is None


def test_wilson(spark):
    low, high = stats.wilson(F.col("s"), F.col("n"))
    got = rows(spark.createDataFrame([(0, 0), (8, 10), (10, 10)], "s long, n long").select("n", "s", low.alias("l"), high.alias("h")))
    assert got[0] == (0, 0, None, None)
    assert got[1] == (10, 8, 0.490157, 0.943319) and got[2][3] == 1.0


def test_binnings_differ_at_their_edges(spark):
    v = votes(spark, *[("a", i, True, "BLOCK", c) for i, c in enumerate([0.0, 0.1, 0.7, 1.0, None])])
    assert rows(calibration.reliability_bins(v), "bin", "n") == [(0, 1), (1, 1), (7, 1), (9, 1)]
    assert calibration.ece_right_closed(v).first()["n"] == 4  # null is no zero
    # right-closed: 0 and 0.1 share the first bin
    assert calibration.ece_right_closed(v).first()["ece"] == round((2 * 0.95 + 0.3 + 0.0) / 4, 6)


def test_prefix_sweep_keeps_ties_apart(spark):
    v = votes(spark, *[("risk", i, True, x, 0.5) for i, x in enumerate(["BLOCK", "PASS", "BLOCK"])])
    assert [r["flips"] for r in calibration.prefix_sweep(v, "risk", 3).orderBy("k").collect()] == [0, 1, 0]


def test_scorecards(spark):
    pairs = spark.createDataFrame([(1, "a", True, True), (1, "b", False, True), (2, "a", True, False)], "case_id long, code string, raised boolean, gold boolean")
    got = {r["code"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in scorecard.flag_scorecard(pairs).collect()}
    assert got == {"a": (1, 1, 0, 0.5, 1.0), "b": (0, 0, 1, None, 0.0), None: (1, 1, 1, 0.5, 0.5)}
    assert rows(scorecard.partial_credit(pairs), "case_id", "credit") == [(1, 0.666667), (2, 0.0)]
    assert rows(scorecard.caught_missed_spurious(pairs)) == [(1, "a", "b", ""), (2, "", "", "a")]


def test_segments_and_nulls(spark):
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "a"])], "k long, seq long, s string")
    assert [(r["start"], r["end"], r["s"], r["n"]) for r in prefix.segments(log, "k", "s", ["seq"]).orderBy("segment").collect()] == [(0, 1, "a", 2), (2, 3, None, 2), (4, 4, "a", 1)]


def test_history(spark):
    log = spark.createDataFrame([("a", 1, 1, "PASS", None), ("a", 1, 2, "BLOCK", "r1"), ("a", 1, 3, "WARN", "r2")], "agent string, case_key long, seq long, verdict string, replay_of string")
    assert history.latest(log, ["agent", "case_key"], "seq", ["verdict"]).first()["verdict"] == "WARN"
    assert history.latest_authoritative(log, ["agent", "case_key"], "seq", ["verdict"]).first()["verdict"] == "PASS"
    assert rows(prefix.versions(log, ["agent", "case_key"], "seq"), "version", "state") == [(1, "superseded"), (2, "superseded"), (3, "current")]
    a, b = spark.createDataFrame([(1, "PASS"), (2, "PASS")], "k long, verdict string"), spark.createDataFrame([(1, "BLOCK"), (3, "PASS")], "k long, verdict string")
    assert rows(history.diff_verdicts(a, b, "k")) == [(1, "PASS", "BLOCK"), (2, "PASS", "ABSENT"), (3, "ABSENT", "PASS")]


def test_units_chain(spark):
    codes = spark.createDataFrame([(1, c, "f", t) for c, t in (("a", ["x", "y"]), ("b", ["y", "z"]), ("c", ["z", "w"]), ("d", ["q"]))], "case_id long, code string, family string, tokens array<string>")
    assert rows(units.finding_units(codes, 8, 0.5)) == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d")]


def test_closure_and_subsumption(spark):
    up = hierarchy.closure(spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string"))
    assert rows(up) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    terms = spark.createDataFrame([(1, "a", "c"), (2, "c", "a"), (3, "x", "a"), (4, "a", "a")], "key long, note string, record string")
    assert rows(units.subsumption_verdicts(terms, up), "key", "verdict") == [(1, "SUPPRESS"), (2, "STAND"), (3, "DEFER"), (4, "SUPPRESS")]


def test_text(spark):
    df = spark.createDataFrame([("Running dogs", "the dogs were running", "a\n\n\n\n# x\nb")], "q string, s string, t string")
    one = df.select(text.salient_stems(F.col("q")).alias("a"), text.overlap_ratio(F.col("q"), F.col("s")).alias("b"), text.overlap_ratio(F.lit(""), F.col("s")).alias("c"), text.without_blank_runs(F.col("t"), "#").alias("d"), text.slug(F.lit(" A b! ")).alias("e"), text.line_with(F.col("t"), F.lit("B")).alias("f")).first()
    assert (one["a"], one["b"], one["c"], one["d"], one["e"], one["f"]) == (["runn", "dog"], 1.0, 0.0, "a\n\nb", "a_b", "b")


def test_hashes(spark):
    import hashlib

    one = spark.range(1).select(hash32("a", F.lit(1)).alias("h"), uniform("a", F.lit(1)).alias("u"), seed31("c", "r").alias("s")).first()
    want = int(hashlib.sha1(b"a|1").hexdigest()[:8], 16)
    assert (one["h"], one["u"]) == (want, want / 2**32)
    assert one["s"] == int(hashlib.sha256(b"c|r").hexdigest()[:8], 16) % 2**31


def test_mutants(spark):
    m = datagen.field_mutants(spark.range(1), "id", spark.createDataFrame([("a", "presence", False), ("b", "enum", True)], "field string, kind string, required boolean"))
    assert rows(m, "field", "mutated", "expected") == [("a", None, "PASS"), ("b", "__not_in_enum__", "BLOCK")]


def test_positive_first_keeps_every_case(spark):
    made = [(i, None if i % 7 == 0 else i % 3 == 0) for i in range(-5, 300)]
    got = datagen.positive_first(spark.createDataFrame(made[::-1], "case_id long, gold_block boolean"), 16).collect()
    assert [(r["case_id"], r["gold_block"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(made, key=lambda x: (not x[1], x[0]))
    assert sorted(r["position"] for r in got) == list(range(305))


def test_slug_takes_the_whole_text(spark, tmp_path):
    from assaylake.plans import scalars

    spark.createDataFrame([(1, " Ab c! " * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert scalars.slugs(spark, str(tmp_path)).first()["slug"] == "_".join(["ab_c"] * 50)
