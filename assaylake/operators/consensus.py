"""Evidence-based consensus of judges, case outcomes and gates. One pass of grouped aggregation over votes and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Codes that one judge alone often raises wrongly: such a finding goes if all others pass.
FALSE_POSITIVES = ("privacy_leak",)


def code_tiers(findings: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Of each case and code, what its tier's rule makes of the judges that raised it.

    Tier 1: two judges with evidence trigger it; one judge, with evidence, triggers it if it owns the code or none does;
    else it is flagged. Tier 2: two judges trigger it, one flags it. Tier 3 is listed, corroborated by two. A listed
    false positive of one judge goes where all other judges of the case pass; without votes none goes.
    """
    one = findings.groupBy("case_id", "code", "role").agg(F.bool_or("has_evidence").alias("evidence"), F.first("tier").alias("tier"), F.first("pillar").alias("pillar"), F.first("owner").alias("owner"))
    by = one.groupBy("case_id", "code").agg(
        F.first("tier").alias("tier"),
        F.first("pillar").alias("pillar"),
        F.count(F.lit(1)).alias("judges"),
        F.count_if("evidence").alias("with_evidence"),
        F.bool_or(F.col("evidence") & ((F.col("owner") == "") | (F.col("owner") == F.col("role")))).alias("owned"),
        F.min("role").alias("role"),
    )
    if votes is not None:
        not_passed = votes.filter(F.col("vote") != "PASS").select("case_id", F.col("role").alias("other"))
        lone = by.filter((F.col("judges") == 1) & F.col("code").isin(*FALSE_POSITIVES)).select("case_id", "code", "role")
        doubted = lone.join(not_passed, "case_id").filter(F.col("other") != F.col("role")).select("case_id", "code").distinct()
        gone = lone.select("case_id", "code").join(doubted, ["case_id", "code"], "left_anti")
        by = by.join(gone, ["case_id", "code"], "left_anti")
    first = F.when((F.col("judges") >= 2) & (F.col("with_evidence") >= 2), "triggered").when((F.col("judges") == 1) & F.col("owned"), "triggered").otherwise("flagged")
    second = F.when(F.col("judges") >= 2, "triggered").otherwise("flagged")
    third = F.when(F.col("judges") >= 2, "corroborated").otherwise("listed")
    return by.select("case_id", "code", "tier", "pillar", "judges", "with_evidence", F.when(F.col("tier") == 1, first).when(F.col("tier") == 2, second).otherwise(third).alias("state"))


def pillar_verdicts(tiers: DataFrame) -> DataFrame:
    """Verdict of each case's pillar; codes of both pillars count for each."""
    both = tiers.withColumn("pillar", F.explode(F.when(F.col("pillar") == "dual", F.array(F.lit("artifact"), F.lit("conversation"))).otherwise(F.array("pillar"))))
    verdict = F.when(F.bool_or(F.col("state") == "triggered"), "BLOCK").when(F.bool_or(F.col("state").isin("flagged", "corroborated")), "WARN").otherwise("PASS")
    return both.groupBy("case_id", "pillar").agg(verdict.alias("verdict"))


def _worst(rank: Column) -> Column:
    return F.when(rank == 2, "BLOCK").when(rank == 1, "WARN").otherwise("PASS")


def _rank(verdict: Column) -> Column:
    return F.when(verdict == "BLOCK", 2).when(verdict == "WARN", 1).otherwise(0)


def composed(votes: DataFrame, veto: str = "faithfulness") -> DataFrame:
    """Verdict of each case from its votes alone: the veto judge clears it if no other judge blocks, else the worst vote holds."""
    v = votes.groupBy("case_id").agg(
        F.max(_rank(F.col("vote"))).alias("worst"),
        F.bool_or((F.col("role") == veto) & (F.col("vote") == "PASS")).alias("faithful"),
        F.bool_or((F.col("role") != veto) & (F.col("vote") == "BLOCK")).alias("other_block"),
    )
    return v.select("case_id", F.when(F.col("faithful") & ~F.col("other_block"), "PASS").otherwise(_worst(F.col("worst"))).alias("verdict"))


def consensus(votes: DataFrame, findings: DataFrame, gate_mode: bool = False) -> DataFrame:
    """The final verdict of each case. Votes that are not ``usable``, and their findings, count for nothing; without that column all are.

    Below two usable judges (one in gate mode) a case needs review with confidence 0. A triggered tier-1 code decides by
    the evidence of the pillars; else ``composed`` does; a graver verdict of the artifact pillar raises either. Confidence
    is the mean of those given, 0 without any. One vote is a consensus in gate mode.
    """
    good = votes.filter("usable") if "usable" in votes.columns else votes
    held = findings.join(good.select("case_id", "role"), ["case_id", "role"], "left_semi")
    v = good.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("valid"),
        F.greatest(F.count_if(F.col("vote") == "BLOCK"), F.count_if(F.col("vote") == "WARN"), F.count_if(F.col("vote") == "PASS")).alias("majority"),
        F.avg("confidence").alias("mean"),
    )
    tiers = code_tiers(held, good)
    t = tiers.groupBy("case_id").agg(F.count_if((F.col("tier") == 1) & (F.col("state") == "triggered")).alias("tier1"))
    pillars = pillar_verdicts(tiers)
    evidence = pillars.groupBy("case_id").agg(F.max(_rank(F.col("verdict"))).alias("evidence"), F.max(F.when(F.col("pillar") == "artifact", _rank(F.col("verdict"))).otherwise(0)).alias("artifact"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    least = 1 if gate_mode else 2
    j = votes.select("case_id").distinct().join(v, "case_id", "left").join(t, "case_id", "left").join(evidence, "case_id", "left").join(composed(good).withColumnRenamed("verdict", "by_votes"), "case_id", "left")
    j = j.withColumn("enough", zero("valid") >= least)
    top = F.when(zero("tier1") > 0, zero("evidence")).otherwise(_rank(F.col("by_votes")))
    final = F.when(F.col("enough"), _worst(F.greatest(top, zero("artifact")))).otherwise("WARN")
    mean = F.coalesce("mean", F.lit(0.0))
    agreed = (F.col("majority") >= 2) | F.lit(gate_mode) & (F.col("valid") == 1)
    return j.select(
        "case_id",
        zero("valid").cast("long").alias("valid"),
        F.when(F.col("enough"), zero("tier1")).otherwise(0).cast("long").alias("tier1"),
        final.alias("verdict"),
        F.when(F.col("enough"), F.round(mean, 3)).otherwise(0.0).alias("confidence"),
        (F.col("enough") & agreed).alias("consensus"),
        (~F.col("enough") | ~agreed | (mean < 0.6)).alias("uncertain"),
        F.when(~F.col("enough"), "insufficient_valid_models").when(mean < 0.6, "low_confidence").alias("reason"),
    )


def stage_findings(tiers: DataFrame, findings: DataFrame) -> DataFrame:
    """What the semantic stage reports: triggered codes of high severity, flagged and tier-3 ones of medium, each with the first
    judge, by name, that gave evidence (null without any)."""
    first = findings.filter("has_evidence").groupBy("case_id", "code").agg(F.min("role").alias("judge"))
    severity = F.when((F.col("state") == "triggered") & (F.col("tier") < 3), "HIGH").otherwise("MEDIUM")
    detail = F.concat(F.col("code"), F.lit(" (judges="), F.col("judges").cast("string"), F.lit(")"))
    return tiers.join(first, ["case_id", "code"], "left").select("case_id", "code", severity.alias("severity"), detail.alias("detail"), "judge")


def stage_results(results: DataFrame) -> DataFrame:
    """Validator results (case_id, verdict, skipped, error, severity, detail; severity and detail of the failing check, null without one) as stage rows.

    An error warns with one finding of medium severity; without a verdict, or skipped, the stage does not apply and has no
    finding; else the verdict holds, severities are normalized and a check without words says that it failed."""
    from assaylake.operators.records import normalized_severity

    failed, off = F.col("error").isNotNull(), F.col("verdict").isNull() | F.col("skipped").isNotNull()
    status = F.when(failed, "WARN").when(off, "not_applicable").otherwise(F.col("verdict"))
    found = F.col("severity").isNotNull() | F.col("detail").isNotNull()
    severity = F.when(failed, "MEDIUM").when(~off & found, normalized_severity(F.coalesce("severity", F.lit(""))))
    detail = F.when(failed, F.concat(F.lit("structural_validation_error: "), "error")).when(~off & found, F.coalesce("detail", F.lit("structural check failed")))
    return results.select("case_id", status.alias("status"), severity.alias("severity"), detail.alias("detail"))


def vote_rows(votes: DataFrame, findings: DataFrame) -> DataFrame:
    """The judges' votes as they are reported: vote, confidence (null stays null) and a reason of the decision and its codes, empty without any."""
    codes = findings.groupBy("case_id", "role").agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"))
    j = votes.join(codes, ["case_id", "role"], "left")
    word = F.when(F.col("vote") == "BLOCK", "reject").when(F.col("vote") == "WARN", "needs_review").otherwise("approve")
    return j.select("case_id", "role", "vote", "confidence", F.coalesce(F.concat(word, F.lit(" \u2014 "), "codes"), F.lit("")).alias("reason"))


def _outcome(decision: str, variance: str | None, limit: float) -> Column:
    is_ = lambda role, v: F.bool_or((F.col("role") == role) & (F.col(decision) == v))
    any_ = lambda v: F.bool_or(F.col(decision) == v)
    unsure = F.bool_or(F.col(variance) >= limit) if variance else F.lit(False)
    return (
        F.when(unsure, "NEEDS_REVIEW")
        .when(is_("risk", "BLOCK"), "CRITICAL")
        .when(is_("policy", "BLOCK"), "POLICY_VIOLATION")
        .when(any_("BLOCK"), "FLAGGED")
        .when(is_("risk", "WARN"), "RISK_FLAG")
        .when(any_("WARN"), "NEEDS_REVIEW")
        .otherwise("CLEAR")
    )


def outcomes_from_votes(votes: DataFrame) -> DataFrame:
    """Named outcome of each case from its single votes, in any of their vocabularies; others are skipped, and null where none is left."""
    from assaylake.operators.records import normalized_verdict

    v = votes.select("case_id", "role", normalized_verdict(F.col("vote")).alias("decision"))
    named = v.filter("decision is not null").groupBy("case_id").agg(_outcome("decision", None, 0.0).alias("outcome"))
    return votes.select("case_id").distinct().join(named, "case_id", "left")


def outcome_verdict(outcome: Column) -> Column:
    return F.when(outcome.isin("CRITICAL", "POLICY_VIOLATION", "FLAGGED"), "BLOCK").when(outcome.isin("RISK_FLAG", "NEEDS_REVIEW"), "WARN").otherwise("PASS")


def grade(votes: DataFrame, findings: DataFrame, disproved: DataFrame, lens: DataFrame, severity: DataFrame) -> DataFrame:
    """Grades cases as one plan: case_id, outcome, verdict, n_findings, n_suppressed, active, grounded, counterfactual, decision.

    Findings without evidence are dropped; findings that do not withstand go, and a judge that blocked on them alone
    passes; the decisions left name the outcome, which is the semantic verdict. The rules of the tiers give the findings;
    disproved ones are suppressed. The verdict only falls where grounding leaves nothing active, and the gate decides.
    """
    spans = findings.filter("has_evidence")
    decided = withstands(votes, spans, disproved, lens)
    outcome = decided.groupBy("case_id").agg(_outcome("decision", None, 0.0).alias("outcome")).withColumn("verdict", outcome_verdict(F.col("outcome")))
    tiers = code_tiers(spans, votes)
    reported = stage_findings(tiers, spans).join(disproved.withColumn("gone", F.lit(True)), ["case_id", "code"], "left").join(severity, "severity", "left")
    live = F.col("gone").isNull()
    by = reported.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(~live).alias("n_suppressed"),
        F.array_join(F.array_sort(F.collect_set(F.when(live, F.col("code")))), ",").alias("active"),
        F.max(F.when(live, F.col("weight"))).alias("now"),
        F.max("weight").alias("before"),
    )
    of_weight = lambda w: F.when(w >= 0.5, "BLOCK").when(w > 0, "WARN").otherwise("PASS")
    j = outcome.join(by, "case_id", "left")
    cleared = (F.coalesce("n_suppressed", F.lit(0)) > 0) & F.col("now").isNull()
    grounded = F.when(cleared, "PASS").otherwise(F.col("verdict"))
    high = F.coalesce(F.col("now") >= 1.0, F.lit(False))
    decision = F.when(grounded == "PASS", "allow").when(grounded == "WARN", "regenerate").when(high, "escalate").otherwise("regenerate")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("case_id", "outcome", "verdict", n("n_findings"), n("n_suppressed"), F.coalesce("active", F.lit("")).alias("active"), grounded.alias("grounded"), of_weight(F.col("before")).alias("counterfactual"), decision.alias("decision"))


def cohort(grades: DataFrame, gold: DataFrame, labeled: DataFrame) -> DataFrame:
    """Scorecard of a graded cohort: active codes against gold, by code and over all, with the cases and those that match exactly."""
    from assaylake.operators import scorecard

    active = grades.select("case_id", F.explode(F.split("active", ",")).alias("code")).filter("code <> ''")
    pairs = scorecard.raised_and_gold(active, gold, labeled)
    return scorecard.flag_scorecard(pairs)


def case_outcomes(votes: DataFrame, variance_limit: float = 0.20) -> DataFrame:
    """Rule table over the judges of each case, each with its modal vote and the variance of its samples."""
    from assaylake.operators.calibration import sampling_reduction

    return sampling_reduction(votes).groupBy("case_id").agg(_outcome("decision", "variance", variance_limit).alias("outcome"))


def withstands(votes: DataFrame, findings: DataFrame, disproved: DataFrame, lens: DataFrame) -> DataFrame:
    """Drops a judge's findings whose code is disproved, and those outside its lens that no judge raised within its own; a judge
    that blocked and has none left passes."""
    left = findings.join(disproved, ["case_id", "code"], "left_anti")
    inside = left.join(lens, ["role", "code"], "left_semi")
    outside = left.join(lens, ["role", "code"], "left_anti").join(inside.select("case_id", "code").distinct(), ["case_id", "code"], "left_semi")
    kept = inside.unionByName(outside).groupBy("case_id", "role").agg(F.count(F.lit(1)).alias("kept"))
    had = findings.groupBy("case_id", "role").agg(F.count(F.lit(1)).alias("raised"))
    j = votes.join(had, ["case_id", "role"], "left").join(kept, ["case_id", "role"], "left").select("case_id", "role", "vote", F.coalesce("raised", F.lit(0)).cast("long").alias("raised"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
    return j.withColumn("decision", F.when((F.col("vote") == "BLOCK") & (F.col("raised") > 0) & (F.col("kept") == 0), "PASS").otherwise(F.col("vote")))


def gate_decisions(verdicts: DataFrame, findings: DataFrame, gate_mode: bool = False) -> DataFrame:
    """PASS allows; WARN regenerates (allows in gate mode); BLOCK escalates with a finding of high severity, else regenerates."""
    high = findings.groupBy("case_id").agg(F.bool_or(F.col("severity") == "HIGH").alias("high"))
    j = verdicts.join(high, "case_id", "left")
    decision = F.when(F.col("verdict") == "PASS", "allow").when(F.col("verdict") == "WARN", "allow" if gate_mode else "regenerate").when(F.coalesce("high", F.lit(False)), "escalate").otherwise("regenerate")
    return j.select("case_id", "verdict", decision.alias("decision"))


def stage_attribution(stages: DataFrame) -> DataFrame:
    """The stage that set a case's verdict: the worst one, earlier stages (structural, semantic, artifact) first on ties."""
    rank = F.when(F.col("verdict") == "BLOCK", 2).when(F.col("verdict") == "WARN", 1).otherwise(0)
    return stages.groupBy("case_id").agg(F.max_by("stage", F.struct(rank, -F.col("ordinal"))).alias("stage"), F.max(rank).alias("rank"))


def coverage_counts(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


def ground_findings(findings: DataFrame, disproved: DataFrame, severity: DataFrame) -> DataFrame:
    """Findings in their bucket: not gradeable, suppressed (disproved), without evidence, or active with its weight."""
    j = findings.join(disproved.withColumn("gone", F.lit(True)), ["case_id", "code"], "left").join(severity, "severity", "left")
    bucket = F.when(~F.col("gradeable"), "skipped_non_gradeable").when(F.col("gone"), "suppressed").when(~F.col("has_evidence"), "ungrounded").otherwise("active")
    return j.select("case_id", "role", "code", "severity", "weight", bucket.alias("bucket"))


def rescore(buckets: DataFrame, block: float = 0.5, warn: float = 0.0) -> DataFrame:
    """Verdict of the active findings' largest weight, and the verdict had nothing been suppressed."""
    w = lambda *b: F.coalesce(F.max(F.when(F.col("bucket").isin(*b), F.col("weight"))), F.lit(0.0))
    verdict = lambda x: F.when(x >= block, "BLOCK").when(x > warn, "WARN").otherwise("PASS")
    by = buckets.groupBy("case_id").agg(w("active").alias("now"), w("active", "suppressed").alias("before"), F.count_if(F.col("bucket") == "suppressed").alias("suppressed"))
    return by.select("case_id", "suppressed", verdict(F.col("now")).alias("verdict"), verdict(F.col("before")).alias("counterfactual"))
