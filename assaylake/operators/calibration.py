"""Calibration and accuracy: Wilson intervals, both calibration binnings, Brier score, selective prediction, prefix sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stats import ratio, wilson


def decision_score(vote: Column) -> Column:
    """0 for BLOCK, 0.5 for WARN, 1 for PASS."""
    return F.when(vote == "BLOCK", 0.0).when(vote == "WARN", 0.5).otherwise(1.0)


def graded(votes: DataFrame) -> DataFrame:
    """Votes with ``ok``: blocking agrees with gold."""
    return votes.withColumn("ok", (F.col("vote") == "BLOCK") == F.col("gold_block"))


def accuracy(votes: DataFrame) -> DataFrame:
    g = graded(votes).groupBy("role").agg(F.count_if("ok").alias("successes"), F.count(F.lit(1)).alias("trials"))
    low, high = wilson(F.col("successes"), F.col("trials"))
    return g.select("role", "successes", "trials", F.round(ratio(F.col("successes"), F.col("trials")), 6).alias("value"), low.alias("ci_low"), high.alias("ci_high"))


def _ece(votes: DataFrame, bin_of: Column) -> DataFrame:
    bins = graded(votes).filter("confidence is not null").withColumn("bin", bin_of).groupBy("role", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg(F.col("ok").cast("double")).alias("acc"))
    return bins.groupBy("role").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def ece_right_closed(votes: DataFrame, bins: int = 10) -> DataFrame:
    """Bins (lo, hi]; confidence 0 falls in the first."""
    return _ece(votes, F.greatest(F.ceil(F.col("confidence") * bins) - 1, F.lit(0)))


def reliability_bins(votes: DataFrame, bins: int = 10) -> DataFrame:
    """Bins [lo, hi), the last also takes 1: size, mean confidence, accuracy, and a caveat for under five votes."""
    g = graded(votes).filter("confidence is not null").withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"))
    return g.groupBy("role", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"), (F.count(F.lit(1)) < 5).alias("caveat")
    )


def pooled_check(votes: DataFrame, bins: int = 10, limit: float = 0.15) -> DataFrame:
    """Match rate and size-weighted calibration error over all judges, with an advisory status."""
    ece = ece_right_closed(votes, bins).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("ece")) / F.sum("n")).alias("e"))
    match = graded(votes).agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("match_rate"))
    return match.crossJoin(ece).select("match_rate", "n", F.round("e", 6).alias("pooled_ece"), F.when(F.col("e") > limit, "WARN").otherwise("PASS").alias("advice"))


def brier(votes: DataFrame) -> DataFrame:
    x = F.col("confidence") - F.col("ok").cast("double")
    return graded(votes).filter("confidence is not null").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x * x), 6).alias("brier"))


def selective(votes: DataFrame, abstain: str = "WARN") -> DataFrame:
    """A judge abstains with WARN: coverage, accuracy where it decides with its interval, and the risk left."""
    n = graded(votes).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vote") != abstain).alias("decided"), F.count_if((F.col("vote") != abstain) & F.col("ok")).alias("right"))
    low, high = wilson(F.col("right"), F.col("decided"))
    acc = ratio(F.col("right"), F.col("decided"))
    return n.select("role", "n", "decided", F.round(ratio(F.col("decided"), F.col("n")), 6).alias("coverage"), F.round(acc, 6).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"), F.round(1 - acc, 6).alias("risk"))


def prefix_sweep(votes: DataFrame, role: str, k_max: int) -> DataFrame:
    """For each k: the majority over a case's first k samples against that over all its samples, the reference.

    A score below 0.5 votes to block, above it to pass, and 0.5 abstains; a tie is undecided. ``flips`` are cases whose
    majority differs from the reference, an undecided one included; ``converged`` are those decided alike. Both shares
    have their interval; the variance is the mean of the population variances of the first k scores.
    """
    one = votes.filter(F.col("role") == role).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", decision_score(F.col("vote")).alias("s")))), lambda x: x["s"]).alias("s"))

    def majority(scores: Column) -> Column:
        passed, block = F.size(F.filter(scores, lambda x: x > 0.5)), F.size(F.filter(scores, lambda x: x < 0.5))
        return F.when(block > passed, "BLOCK").when(passed > block, "PASS").otherwise("TIE")

    def variance(scores: Column) -> Column:
        n = F.size(scores)
        mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
        return F.aggregate(scores, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n

    by_k = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k_max)))).filter(F.size("s") >= F.col("k"))
    by_k = by_k.withColumn("head", F.slice("s", 1, F.col("k"))).withColumn("now", majority(F.col("head"))).withColumn("at_last", majority(F.col("s")))
    n = by_k.groupBy("k").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("now") != F.col("at_last")).alias("flips"),
        F.count_if((F.col("now") == F.col("at_last")) & (F.col("at_last") != "TIE")).alias("converged"),
        F.round(F.avg(variance(F.col("head"))), 6).alias("mean_variance"),
    )
    low, high = wilson(F.col("flips"), F.col("cases"))
    first, last = wilson(F.col("converged"), F.col("cases"))
    rate = lambda c: F.round(ratio(F.col(c), F.col("cases")), 6)
    return n.select("k", "cases", "flips", rate("flips").alias("flip_rate"), low.alias("ci_low"), high.alias("ci_high"), "converged", rate("converged").alias("convergence"), first.alias("convergence_low"), last.alias("convergence_high"), "mean_variance")


def risk_determinations(votes: DataFrame) -> DataFrame:
    """Votes of each run by risk category: mean of the confidences that are neither null nor zero, and the severity's rank."""
    category = F.when(F.col("vote") == "BLOCK", "high").when(F.col("vote") == "WARN", "medium").otherwise("none")
    g = votes.groupBy("role", "run", category.alias("category"))
    rank = F.when(F.col("category") == "high", 0).when(F.col("category") == "medium", 1).otherwise(2)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))), 3).alias("confidence")).withColumn("severity_rank", rank)


def sampling_reduction(votes: DataFrame) -> DataFrame:
    """A judge's repeated samples of a case: mean score, population variance and the decision seen most, ties to the first."""
    from assaylake.operators.rollup import mode_by_first_seen

    score = decision_score(F.col("vote"))
    mean = votes.groupBy("case_id", "role").agg(F.round(F.avg(score), 6).alias("score_mean"), F.round(F.var_pop(score), 6).alias("variance"))
    modal = mode_by_first_seen(votes, ["case_id", "role"], "vote", "run").select("case_id", "role", F.col("modal").alias("decision"), "n")
    return mean.join(modal, ["case_id", "role"])


def k_majority(votes: DataFrame) -> DataFrame:
    """More than half of a case's samples violated: false; satisfied: true; else null."""
    n = votes.groupBy("case_id", "role").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("vote") == "BLOCK").alias("violated"), F.count_if(F.col("vote") == "PASS").alias("satisfied"))
    half = F.floor(F.col("k") / 2)
    return n.select("case_id", "role", "k", F.when(F.col("violated") > half, False).when(F.col("satisfied") > half, True).alias("conforms"))
