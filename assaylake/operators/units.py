"""Finding units: codes of one family that point at the same evidence count once. Also verdicts of subsumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stats import precision_recall
from assaylake.shared import Scratch


def unit_edges(codes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of codes of one case and family of which any two quotes overlap by containment of at least ``threshold``.

    ``codes`` has case_id, code, family and quotes, an array of token arrays, or tokens, a single quote; a case has as many
    rows as the taxonomy has codes, so pairs are bounded. Codes without a family, and without quotes, have no edge.
    """
    if "quotes" not in codes.columns:
        codes = codes.withColumn("quotes", F.array("tokens"))
    a, b = (codes.filter("family <> ''").select("case_id", "family", F.col("code").alias(c), F.col("quotes").alias(q)) for c, q in (("a", "x"), ("b", "y")))
    near = lambda p, q: (F.least(F.size(p), F.size(q)) > 0) & (F.size(F.array_intersect(p, q)) / F.least(F.size(p), F.size(q)) >= threshold)
    return a.join(b, ["case_id", "family"]).filter((F.col("a") < F.col("b")) & F.exists("x", lambda p: F.exists("y", lambda q: near(p, q)))).select("case_id", "a", "b")


def finding_units(codes: DataFrame, max_codes: int, threshold: float = 0.6) -> DataFrame:
    """case_id, code, unit: the smallest code that is reachable within the case. Labels spread once for each code at most.

    ``codes`` is written once, as each side of the edges and the rows read it."""
    codes = Scratch(codes.sparkSession, "codes").written(codes)
    edges = unit_edges(codes, threshold)
    both = edges.unionByName(edges.select("case_id", F.col("b").alias("a"), F.col("a").alias("b")))
    # the codes of a case are few: reach is grown on one row a case, without rounds of shuffles
    near = both.groupBy("case_id", "a").agg(F.collect_set("b").alias("near"))
    rows = codes.select("case_id", "code").join(near.withColumnRenamed("a", "code"), ["case_id", "code"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))
    case = rows.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("code", F.array_union(F.array("code"), F.col("near"))))).alias("reach"))
    step = lambda m: F.transform_values(m, lambda k, v: F.array_distinct(F.flatten(F.transform(v, lambda x: F.element_at(m, x)))))
    done = 1
    while done < max_codes:  # reach doubles
        case = case.withColumn("reach", step(F.col("reach")))
        done *= 2
    return case.select("case_id", F.explode("reach").alias("code", "all")).select("case_id", "code", F.array_min("all").alias("unit"))


def unit_scores(units: DataFrame, gold: DataFrame, families: DataFrame) -> DataFrame:
    """A unit is right if it holds a gold code or one of a gold code's family; recall is over gold codes.

    ``units`` and ``gold`` are written once, as the counts read them several times."""
    scratch = Scratch(units.sparkSession, "units")
    units, gold = scratch.written(units), scratch.written(gold.select("case_id", "code"))
    named = gold.join(families, "code", "left").select("case_id", F.col("code").alias("gold_code"), "family")
    closure = named.filter("family <> ''").join(families.withColumnRenamed("code", "member"), "family").select("case_id", F.col("member").alias("code")).unionByName(named.select("case_id", F.col("gold_code").alias("code"))).distinct()
    hit = units.join(closure, ["case_id", "code"], "left_semi").select("case_id", "unit").distinct().withColumn("hit", F.lit(True))
    all_units = units.select("case_id", "unit").distinct()
    n = all_units.join(hit, ["case_id", "unit"], "left").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.coalesce("hit", F.lit(False))).alias("tp"))
    reached = units.join(families, "code", "left").select("case_id", "code", "family")
    caught = named.join(reached.select("case_id", F.col("code").alias("gold_code"), F.lit(True).alias("same")), ["case_id", "gold_code"], "left")
    kin = reached.filter("family <> ''").select("case_id", "family").distinct().withColumn("kin", F.lit(True))
    caught = caught.join(kin, ["case_id", "family"], "left").agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.coalesce("same", "kin", F.lit(False))).alias("caught"))
    p, _ = precision_recall(F.col("tp"), F.col("units") - F.col("tp"), F.lit(0))
    _, r = precision_recall(F.col("caught"), F.lit(0), F.col("gold") - F.col("caught"))
    return n.crossJoin(caught).select("units", "tp", "gold", "caught", p.alias("precision"), r.alias("recall"))


def headline(pass_scores: DataFrame, metric: str, least: int = 3) -> DataFrame:
    """Mean, least, largest and spread of a metric over passes; ``below_target`` with fewer passes than ``least``."""
    return pass_scores.agg(
        F.count(metric).alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.round(F.max(metric) - F.min(metric), 6).alias("spread"), (F.count(metric) < least).alias("below_target")
    )


def pass_scores(findings: DataFrame, gold: DataFrame) -> DataFrame:
    """Strict precision and recall of each run taken as a pass."""
    raised = findings.select("run", "case_id", "code").distinct()
    tp = raised.join(gold, ["case_id", "code"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("tp"))
    n = raised.groupBy("run").agg(F.count(F.lit(1)).alias("raised"))
    total = gold.agg(F.count(F.lit(1)).alias("gold"))
    j = n.join(tp, "run", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).crossJoin(total)
    p, r = precision_recall(F.col("tp"), F.col("raised") - F.col("tp"), F.col("gold") - F.col("tp"))
    return j.select("run", "raised", F.col("tp").cast("long").alias("tp"), "gold", p.alias("precision"), r.alias("recall"))


def subsumption_verdicts(terms: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Of each (key, note, record): SUPPRESS where both are equal or the record's concept is a kind of the note's, STAND where the note's
    is a kind of the record's, else DEFER."""
    up = ancestors.select(F.col("child").alias("record"), F.col("ancestor").alias("note"), F.lit(True).alias("up"))
    down = ancestors.select(F.col("child").alias("note"), F.col("ancestor").alias("record"), F.lit(True).alias("down"))
    j = terms.join(up, ["record", "note"], "left").join(down, ["record", "note"], "left")
    return j.select("key", "note", "record", F.when((F.col("note") == F.col("record")) | F.col("up"), "SUPPRESS").when(F.col("down"), "STAND").otherwise("DEFER").alias("verdict"))
