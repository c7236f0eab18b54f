"""Determinism rollups over repeated runs: per case, per pack, modes, pins, majorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stats import ratio


def mode_by_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group, ties to that seen first in ``order``; with its count and the group's size."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias("modal"), F.max("n").alias("modal_n"), F.sum("n").alias("n"))


def fleiss_terms(rows: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Of each item its raters n and the agreeing pairs over categories."""
    counts = rows.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("raters"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))


def case_rollup(votes: DataFrame) -> DataFrame:
    """Per case over the runs' composed verdicts: counts, modal verdict, instability, match with gold."""
    runs = compose_runs(votes)
    modal = mode_by_first_seen(runs, ["case_id"], "verdict", "run")
    counts = runs.groupBy("case_id").agg(
        F.first("gold_block").alias("gold_block"),
        F.count_if(F.col("verdict") == "BLOCK").alias("n_block"),
        F.count_if(F.col("verdict") == "WARN").alias("n_warn"),
        F.count_if(F.col("verdict") == "PASS").alias("n_pass"),
        F.count_if((F.col("verdict") == "BLOCK") == F.col("gold_block")).alias("n_match"),
    )
    return modal.join(counts, "case_id").select(
        "case_id",
        "gold_block",
        "n",
        "n_block",
        "n_warn",
        "n_pass",
        F.col("modal").alias("modal_verdict"),
        F.round(1 - F.col("modal_n") / F.col("n"), 4).alias("instability"),
        F.round(F.col("n_match") / F.col("n"), 4).alias("match_rate"),
    )


def compose_runs(votes: DataFrame) -> DataFrame:
    """One verdict for each case and run: the vote that most judges gave, BLOCK before WARN before PASS on ties."""
    n = lambda v: F.count_if(F.col("vote") == v)
    by = votes.groupBy("case_id", "run").agg(F.first("gold_block").alias("gold_block"), n("BLOCK").alias("b"), n("WARN").alias("w"), n("PASS").alias("p"))
    verdict = F.when((F.col("b") >= F.col("w")) & (F.col("b") >= F.col("p")), "BLOCK").when(F.col("w") >= F.col("p"), "WARN").otherwise("PASS")
    return by.select("case_id", "run", "gold_block", verdict.alias("verdict"))


def pack_rollup(votes: DataFrame) -> DataFrame:
    """Over all cases: mean match rate, share of unstable cases, and of the clean cases those whose modal verdict blocks or asks for review."""
    c = case_rollup(votes)
    clean = ~F.col("gold_block")
    return c.agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg("match_rate"), 4).alias("mean_match_rate"),
        F.round(F.avg((F.col("instability") > 0).cast("double")), 4).alias("instability_rate"),
        F.round(ratio(F.count_if(clean & F.col("modal_verdict").isin("BLOCK", "WARN")), F.count_if(clean)), 4).alias("false_block_rate"),
    )


def majority_flags(findings: DataFrame, runs: int) -> DataFrame:
    """Codes that more than half of the runs raised for a case."""
    raised = findings.select("case_id", "run", "code").distinct()
    return raised.groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") * 2 > runs)


def intra_judge_stability(votes: DataFrame) -> DataFrame:
    """Of each judge: one minus the mean share of votes off the mode, over its cases with two repeats or more."""
    modal = mode_by_first_seen(votes, ["role", "case_id"], "vote", "run").filter("n >= 2")
    return modal.groupBy("role").agg(F.count(F.lit(1)).alias("cases"), F.round(1 - F.avg(1 - F.col("modal_n") / F.col("n")), 6).alias("stability"))


def pin_guard(run_log: DataFrame, pin: list[str], key: str) -> DataFrame:
    """Distinct pins of each key; more than one may not be compared."""
    pins = run_log.select(key, F.concat_ws("|", *pin).alias("pin")).distinct()
    return pins.groupBy(key).agg(F.count(F.lit(1)).alias("pins"), F.min("pin").alias("first_pin")).withColumn("cross_pin", F.col("pins") > 1)


def split_counts(rows: DataFrame, split: str, values: list[str]) -> DataFrame:
    """Rows of each split; zeros for splits without rows."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], "split string")
    return every.join(rows.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def code_usage(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")
