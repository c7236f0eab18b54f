"""Agreement between judges and with gold: kappas, error correlation, effective votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stats import effective_votes as _effective
from assaylake.functions.stats import phi, ratio


def fleiss_kappa(rows: DataFrame, item: list[str], category: str, by: list[str] = [], guarded: bool = True) -> DataFrame:  # noqa: B006
    """Fleiss' kappa over items with equally many raters.

    Guarded: null with ``insufficient`` below two items or two raters. Otherwise 1.0 where chance agreement is complete.
    """
    counts = rows.groupBy(*by, *item, category).agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy(*by, *item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    shares = counts.groupBy(*by, category).agg(F.sum("c").alias("c"))
    chance = shares.groupBy(*by).agg((F.sum(F.col("c").cast("double") * F.col("c")) / (F.sum("c").cast("double") * F.sum("c"))).alias("pe"))
    seen = items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.min("r").alias("raters"), F.max("r").alias("most"), F.avg(ratio(F.col("agree"), F.col("r") * (F.col("r") - 1))).alias("p"))
    both = seen.join(chance, by) if by else seen.crossJoin(chance)
    enough = (F.col("items") >= 2) & (F.col("raters") >= 2) & (F.col("raters") == F.col("most"))
    kappa = F.when(F.col("pe") >= 1, 1.0).otherwise(F.round((F.col("p") - F.col("pe")) / (1 - F.col("pe")), 6))
    if not guarded:
        enough = F.col("raters") >= 2
    return both.select(*by, "items", "raters", F.when(enough, kappa).alias("kappa"), (~enough).alias("insufficient"))


def cohen_kappa(rows: DataFrame, predicted: str, gold: str, by: list[str]) -> DataFrame:
    """Two-class kappa of pooled pairs; insufficient where chance agreement is complete."""
    t, p, g = F.lit(1), F.col(predicted), F.col(gold)
    n = rows.groupBy(*by).agg(F.count(t).alias("n"), F.count_if(p == g).alias("same"), F.count_if(p).alias("p1"), F.count_if(g).alias("g1"))
    x = F.col("n").cast("double")
    pe = (F.col("p1") * F.col("g1") + (F.col("n") - F.col("p1")) * (F.col("n") - F.col("g1"))) / (x * x)
    po = F.col("same") / x
    return n.select(*by, "n", F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"), (pe >= 1).alias("insufficient"))


def judge_errors(votes: DataFrame) -> DataFrame:
    """case_id, run, role, err: does the vote's blocking differ from gold."""
    return votes.select("case_id", "run", "role", ((F.col("vote") == "BLOCK") != F.col("gold_block")).alias("err"))


def pairwise_phi(votes: DataFrame) -> DataFrame:
    """Error correlation of each pair of judges, paired by case and run."""
    e = judge_errors(votes)
    # one row a case and run: as many columns as pairs would follow the roles, so pair by join on the key
    a, b = e.select("case_id", "run", F.col("role").alias("role_a"), F.col("err").alias("a")), e.select("case_id", "run", F.col("role").alias("role_b"), F.col("err").alias("b"))
    pairs = a.join(b, ["case_id", "run"]).filter("role_a < role_b")
    c = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    n = pairs.groupBy("role_a", "role_b").agg(c(True, True).alias("n11"), c(True, False).alias("n10"), c(False, True).alias("n01"), c(False, False).alias("n00"))
    return n.select("role_a", "role_b", "n11", "n10", "n01", "n00", phi(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")).alias("phi"))


def effective_votes(votes: DataFrame) -> DataFrame:
    """Mean of the defined pairwise correlations and the independent votes that the panel is worth."""
    mean = pairwise_phi(votes).agg(F.round(F.avg("phi"), 6).alias("mean_phi"), F.count("phi").alias("pairs"))
    k = votes.agg(F.count_distinct("role").alias("k"))
    return k.crossJoin(mean).select("k", "pairs", "mean_phi", _effective(F.col("k"), F.col("mean_phi")).alias("n_eff"))


def arm_agreement(votes: DataFrame, baseline: int, other: int) -> DataFrame:
    """Two runs as arms, joined per case and role: agreement in percent and the mean confidence change where both are known."""
    arm = lambda run, v, c: votes.filter(F.col("run") == run).select("case_id", "role", F.col("vote").alias(v), F.col("confidence").alias(c))
    both = arm(baseline, "va", "ca").join(arm(other, "vb", "cb"), ["case_id", "role"])
    return both.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.avg((F.col("va") == F.col("vb")).cast("double")), 2).alias("agreement_percent"),
        F.round(F.avg(F.col("cb") - F.col("ca")), 6).alias("mean_confidence_delta"),
        F.count(F.col("cb") - F.col("ca")).alias("n_paired"),
    )
