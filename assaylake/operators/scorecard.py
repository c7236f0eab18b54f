"""Scorecards of raised against gold codes: flags, judges, majority, lenses, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stats import precision_recall, ratio


def raised_and_gold(findings: DataFrame, gold: DataFrame, labeled: DataFrame) -> DataFrame:
    """case_id, code, raised, gold over the labeled cases: a full outer join of what was raised and what is gold."""
    raised = findings.join(labeled.select("case_id"), "case_id", "left_semi").select("case_id", "code").distinct().withColumn("raised", F.lit(True))
    return raised.join(gold.select("case_id", "code").withColumn("gold", F.lit(True)), ["case_id", "code"], "full_outer").select("case_id", "code", F.coalesce("raised", F.lit(False)).alias("raised"), F.coalesce("gold", F.lit(False)).alias("gold"))


def _counts() -> list[Column]:
    r, g = F.col("raised"), F.col("gold")
    return [F.count_if(r & g).alias("tp"), F.count_if(r & ~g).alias("fp"), F.count_if(~r & g).alias("fn")]


def flag_scorecard(pairs: DataFrame) -> DataFrame:
    """Hits and misses of each code and, with a null code, of all together; precision and recall null without a denominator."""
    p, r = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return pairs.groupingSets([["code"], []], "code").agg(*_counts()).select("code", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))


def judge_scorecard(findings: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits and misses of each judge over the codes that are gold somewhere among its labeled cases."""
    mine = findings.select("role", "case_id", "code").distinct()
    due = findings.select("role").distinct().crossJoin(gold.select("case_id", "code"))
    pairs = mine.withColumn("raised", F.lit(True)).join(due.withColumn("gold", F.lit(True)), ["role", "case_id", "code"], "full_outer")
    pairs = pairs.withColumn("raised", F.coalesce("raised", F.lit(False))).withColumn("gold", F.coalesce("gold", F.lit(False)))
    p, r = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return pairs.groupBy("role").agg(*_counts()).select("role", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))


def majority_scorecard(votes: DataFrame) -> DataFrame:
    """Blocking majority of each case, with TIE as a verdict of its own, against gold."""
    by = votes.groupBy("case_id").agg(F.first("gold_block").alias("gold"), F.count_if(F.col("vote") == "BLOCK").alias("b"), F.count_if(F.col("vote") == "PASS").alias("p"))
    verdict = F.when(F.col("b") > F.col("p"), "BLOCK").when(F.col("p") > F.col("b"), "PASS").otherwise("TIE")
    return by.groupBy(verdict.alias("majority")).agg(F.count(F.lit(1)).alias("cases"), F.count_if("gold").alias("gold_block"), F.count_if(~F.col("gold")).alias("gold_clean"))


def lens_confusion(findings: DataFrame, gold: DataFrame, lens: DataFrame, labeled: DataFrame) -> DataFrame:
    """Each judge within its lens (role, code): truth is the gold codes in the lens; raising outside it counts apart."""
    mine = findings.join(labeled.select("case_id"), "case_id", "left_semi").select("role", "case_id", "code").distinct()
    inside = mine.join(lens, ["role", "code"], "left_semi").withColumn("raised", F.lit(True))
    outside = mine.join(lens, ["role", "code"], "left_anti").groupBy("role").agg(F.count(F.lit(1)).alias("out_of_lens"))
    due = gold.join(lens, "code").select("role", "case_id", "code").withColumn("gold", F.lit(True))
    pairs = inside.join(due, ["role", "case_id", "code"], "full_outer").withColumn("raised", F.coalesce("raised", F.lit(False))).withColumn("gold", F.coalesce("gold", F.lit(False)))
    return pairs.groupBy("role").agg(*_counts()).join(outside, "role", "left").select("role", "tp", "fp", "fn", F.coalesce("out_of_lens", F.lit(0)).cast("long").alias("out_of_lens"))


def partial_credit(pairs: DataFrame) -> DataFrame:
    """Per case: 1 for an exact match, else 2tp / (2tp + fp + fn)."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return pairs.groupBy("case_id").agg(*_counts()).select("case_id", "tp", "fp", "fn", F.when(fp + fn == 0, 1.0).otherwise(F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)).alias("credit"))


def caught_missed_spurious(pairs: DataFrame) -> DataFrame:
    """Codes of each case as sorted lists: gold and raised, gold alone, raised alone."""
    pick = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("code")))), ",")
    r, g = F.col("raised"), F.col("gold")
    return pairs.groupBy("case_id").agg(pick(r & g).alias("caught"), pick(~r & g).alias("missed"), pick(r & ~g).alias("spurious"))


def release_gate(outcomes: DataFrame, pairs: DataFrame, codes: DataFrame, threshold: float = 96.0) -> DataFrame:
    """Reliability in percent of the cases whose verdict matches, and never-events: cases with a tier-1 code on one side only."""
    never = pairs.filter("raised <> gold").join(codes.filter("tier = 1"), "code", "left_semi").agg(F.count_distinct("case_id").alias("never_events"))
    hit = outcomes.agg(F.round(100 * F.avg(F.col("match").cast("double")), 4).alias("reliability"), F.count(F.lit(1)).alias("cases"))
    return hit.crossJoin(never).withColumn("released", (F.col("reliability") >= threshold) & (F.col("never_events") == 0))


def gold_predicates(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Two rules that differ on cases labeled without codes: has_gold asks for a blocking verdict or codes, labeled for a label."""
    n = gold.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_codes"))
    c = cases.join(n, "case_id", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)).cast("long"))
    return c.select("case_id", "n_codes", "labeled", (F.coalesce("gold_block", F.lit(False)) | (F.col("n_codes") > 0)).alias("has_gold"))


def descoped_gold(gold: DataFrame, codes: DataFrame) -> DataFrame:
    """Gold codes that are gradeable; ``dropped`` cases lost all of theirs and leave the labeled set."""
    kept = gold.join(codes.select("code", "gradeable"), "code")
    n = kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count_if("gradeable").alias("n_gradeable"))
    return n.withColumn("dropped", (F.col("n_gold") > 0) & (F.col("n_gradeable") == 0))


def outside_snapshot(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Raised codes that a taxonomy does not know, with their number."""
    return findings.join(known, "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def label_owners(cases: DataFrame, gold: DataFrame, codes: DataFrame) -> DataFrame:
    """Each code's tier, owner and number of gold cases, codes without cases too."""
    n = gold.groupBy("code").agg(F.count_distinct("case_id").alias("cases"))
    return codes.join(n, "code", "left").select("code", "tier", "owner", F.coalesce("cases", F.lit(0)).cast("long").alias("cases"))


def floor_flips(run_log: DataFrame) -> DataFrame:
    """Of each agent: the latest authoritative run of each case against the one before, counting BLOCK to PASS flips."""
    w = "partition by agent, case_key order by ts desc, seq desc"
    last = run_log.filter("replay_of is null").selectExpr("agent", "case_key", "verdict", f"row_number() over ({w}) as k", f"lead(verdict) over ({w}) as before").filter("k = 1")
    return last.groupBy("agent").agg(F.count(F.lit(1)).alias("cases"), F.count_if((F.col("before") == "BLOCK") & (F.col("verdict") == "PASS")).alias("flips"))
