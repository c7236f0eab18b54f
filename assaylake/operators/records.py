"""Predicates and projections over single records, and small joins of configuration with what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for a blocking verdict in the vocabularies that meet in one column.
BLOCKING = ("BLOCK", "FAIL", "REJECT")


def blocked(verdict: Column) -> Column:
    return F.upper(F.trim(verdict)).isin(*BLOCKING)


def normalized_verdict(verdict: Column) -> Column:
    """PASS, WARN or BLOCK from either vocabulary; null from others."""
    v = F.lower(F.trim(verdict))
    return F.when(v.isin("pass", "approve"), "PASS").when(v.isin("warn", "needs_review"), "WARN").when(v.isin("block", "fail", "reject"), "BLOCK")


def expected_set(value: Column) -> Column:
    """The verdicts that a case expects, from one word or a JSON list of words; none for null; anything else is an error."""
    text = F.trim(value)
    listed = F.from_json(text, "array<string>")
    bad = F.raise_error(F.concat(F.lit("no verdict: "), text)).cast("array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.coalesce(F.array_distinct(listed), bad)).when(text.startswith("{"), bad).otherwise(F.array(text))


def expects_block(expected: Column) -> Column:
    return F.array_contains(expected, "reject")


def matches_expected(observed: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(expected, observed), F.lit(False))


def normalized_severity(raw: Column) -> Column:
    """HIGH, MEDIUM or LOW; synonyms map, anything else is MEDIUM."""
    v = F.lower(F.trim(raw))
    return F.when(v.isin("high", "critical", "severe"), "HIGH").when(v.isin("low", "minor", "info"), "LOW").otherwise("MEDIUM")


def dated_model(name: Column) -> Column:
    """Does a model's name end with a snapshot date."""
    return F.coalesce(name.rlike(r"(-|@)[0-9]{4}-?[0-9]{2}-?[0-9]{2}$"), F.lit(False))


def vote_errors(votes: DataFrame) -> DataFrame:
    """Faults of each vote, comma-joined: unknown decision, confidence outside [0, 1] (null is allowed), no summary."""
    c = F.col("confidence")
    faults = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("vote").isin("PASS", "WARN", "BLOCK"), F.lit(False)), F.lit("decision")),
            F.when((c < 0) | (c > 1), F.lit("confidence")),
            F.when(F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0, F.lit("summary")),
        )
    )
    return votes.select("case_id", "role", "run", F.array_join(faults, ",").alias("errors"), (F.size(faults) == 0).alias("usable"))


def role_relevant(cases: DataFrame, gold: DataFrame, lens: DataFrame) -> DataFrame:
    """Cases for each judge: with a gold code in its lens, or without any gold code."""
    inside = gold.join(lens, "code").select("role", "case_id").distinct()
    clean = cases.select("case_id").join(gold.select("case_id").distinct(), "case_id", "left_anti").crossJoin(lens.select("role").distinct())
    return inside.unionByName(clean.select("role", "case_id")).groupBy("role").agg(F.count(F.lit(1)).alias("cases"))


def taxonomy_lint(cases: DataFrame, gold: DataFrame, codes: DataFrame) -> DataFrame:
    """Gold codes that the taxonomy lacks (D1), and tier-1 gold on a case whose declared verdict does not block (D8)."""
    unknown = gold.join(codes.select("code"), "code", "left_anti").select("case_id", "code", F.lit("D1").alias("rule"))
    soft = gold.join(codes.filter("tier = 1").select("code"), "code", "left_semi").join(cases.filter("not declared_block").select("case_id"), "case_id", "left_semi").select("case_id", "code", F.lit("D8").alias("rule"))
    return unknown.unionByName(soft)


def readiness(codes: DataFrame, lens: DataFrame, observed: DataFrame) -> DataFrame:
    """Configuration checks: codes without an owner, codes in nobody's lens, gradeable codes never raised, raised codes unknown."""
    flag = lambda df, check, severity: df.select(F.lit(check).alias("check"), "code", F.lit(severity).alias("severity"))
    return (
        flag(codes.filter("owner = ''"), "no_owner", "warn")
        .unionByName(flag(codes.join(lens.select("code").distinct(), "code", "left_anti"), "no_lens", "error"))
        .unionByName(flag(codes.filter("gradeable").join(observed, "code", "left_anti"), "never_raised", "info"))
        .unionByName(flag(observed.join(codes.select("code"), "code", "left_anti"), "unknown", "error"))
    )


def incomplete_envelopes(docs: DataFrame, body: str, required: list[str]) -> DataFrame:
    """Required top-level fields of a JSON body that are missing, null or empty."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.get_json_object(body, f"$.{k}")), F.lit("")) == "", F.lit(k)) for k in required]))
    return docs.withColumn("missing", F.array_join(missing, ",")).filter(F.size(missing) > 0)


def cache_replay(runs: DataFrame) -> DataFrame:
    """A paid run with no tokens is suspicious; with unknown tokens it is not flagged."""
    return runs.withColumn("suspicious", F.coalesce(F.col("paid") & (F.col("tokens") == 0), F.lit(False)))


def effective_lens(owned: DataFrame, assigned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Codes of each judge, for each of the keys, by ownership or assignment."""
    names = [*(keys or []), "role", "code"]
    return owned.select(*names).union(assigned.select(*names)).distinct()


def roster(production: list[str], observed: DataFrame) -> DataFrame:
    """Production judges in their order, then all others by name."""
    first = F.array(*[F.lit(x) for x in production])
    names = observed.agg(F.array_sort(F.collect_set("role")).alias("all"))
    return names.select(F.posexplode(F.concat(F.array_intersect(first, "all"), F.array_except("all", first))).alias("place", "role"))


def family_closure(gold: DataFrame, codes: DataFrame) -> DataFrame:
    """Gold codes with the other members of their families."""
    named = gold.join(codes.select("code", "family"), "code")
    kin = named.filter("family <> ''").select("case_id", "family").join(codes.select("family", "code"), "family").select("case_id", "code")
    return named.select("case_id", "code").union(kin).distinct()


def judge_signals(findings: DataFrame, lens: DataFrame, severity: DataFrame) -> DataFrame:
    """What each judge raised: tier, weight, and whether its lens holds the code."""
    seen = findings.select("case_id", "role", "code", "tier", "severity").distinct()
    return seen.join(lens.withColumn("inside", F.lit(True)), ["role", "code"], "left").join(severity, "severity").select("case_id", "role", "code", "tier", "weight", F.coalesce("inside", F.lit(False)).alias("in_lens"))


def worst_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two backends' rows of a case: the graver verdict and the union of their flags."""
    rank = lambda c: F.when(c == "BLOCK", 2).when(c == "WARN", 1).otherwise(0)
    j = a.select("case_id", F.col("verdict").alias("va"), F.col("flags").alias("fa")).join(b.select("case_id", F.col("verdict").alias("vb"), F.col("flags").alias("fb")), "case_id")
    worst = F.greatest(rank(F.col("va")), rank(F.col("vb")))
    return j.select("case_id", F.when(worst == 2, "BLOCK").when(worst == 1, "WARN").otherwise("PASS").alias("verdict"), F.array_join(F.array_sort(F.array_union("fa", "fb")), ",").alias("flags"))


def worst_with_artifact(structural: Column, semantic: Column, artifact: Column) -> Column:
    """The graver of the structural and the semantic verdict; the artifact's counts if it blocks, its WARN never does."""
    rank = lambda c: F.when(c == "BLOCK", 2).when(c == "WARN", 1).otherwise(0)
    worst = F.greatest(rank(structural), rank(semantic), F.when(artifact == "BLOCK", 2).otherwise(0))
    return F.when(worst == 2, "BLOCK").when(worst == 1, "WARN").otherwise("PASS")


def gold_verdicts(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold verdict of each case: the declared one, else BLOCK with a gold code; cases with neither have no row."""
    flagged = gold.select("case_id").distinct().withColumn("flagged", F.lit("BLOCK"))
    return cases.join(flagged, "case_id", "left").select("case_id", F.coalesce("declared", "flagged").alias("gold_verdict")).filter("gold_verdict is not null")


def ensemble(votes: DataFrame) -> DataFrame:
    """More than half of a case's members reject: the ensemble does, with the rejecting members named."""
    reject = F.col("vote") == "BLOCK"
    n = votes.groupBy("case_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(reject).alias("rejects"), F.array_join(F.array_sort(F.collect_set(F.when(reject, F.col("role")))), ",").alias("by"))
    return n.select("case_id", "members", "rejects", F.when(F.col("rejects") * 2 > F.col("members"), "BLOCK").otherwise("PASS").alias("verdict"), F.when(F.col("rejects") * 2 > F.col("members"), F.col("by")).otherwise("").alias("rejecting"))


def ledger(log: DataFrame, key: str, order: str) -> DataFrame:
    """Entries of each key, numbered from the oldest, with the newest marked as current."""
    n = log.withColumn("entry", F.expr(f"row_number() over (partition by {key} order by {order})"))
    return n.withColumn("current", F.expr(f"lead({order}) over (partition by {key} order by {order}) is null"))


def turn_segments(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """The first of a span's turn ids that names a segment, ids compared as text; null times where none does."""
    ids = spans.select("span_id", "conv_id", F.posexplode_outer("turn_ids").alias("place", "turn"))
    j = ids.join(segments.select("conv_id", F.col("turn").cast("string").alias("turn"), "start_ms"), ["conv_id", "turn"], "left")
    return j.groupBy("span_id").agg(F.min_by("start_ms", F.when(F.col("start_ms").isNotNull(), F.col("place"))).alias("start_ms"))


def latest_judgement(runs: DataFrame, judgements: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs with their gold and the newest judgement about them."""
    last = judgements.groupBy("case_key").agg(F.max_by("verdict", "seq").alias("judgement"))
    return runs.join(gold, "case_key", "left").join(last, "case_key", "left")


def mean_delta(baseline: DataFrame, optimized: DataFrame, key: str, value: str) -> DataFrame:
    j = baseline.select(key, F.col(value).alias("a")).join(optimized.select(key, F.col(value).alias("b")), key)
    return j.select(key, F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def template_score(cases: DataFrame) -> DataFrame:
    """A validator's results: false positives, errors, caught defects, and acceptance, which allows neither of the first two."""
    n = cases.groupBy("template").agg(
        F.count_if((F.col("expected") == "PASS") & (F.col("observed") == "BLOCK")).alias("false_positives"),
        F.count_if(F.col("observed").isNull()).alias("errors"),
        F.count_if((F.col("expected") == "BLOCK") & (F.col("observed") == "BLOCK")).alias("caught"),
        F.count_if(F.col("expected") == "BLOCK").alias("defects"),
    )
    return n.withColumn("accepted", (F.col("false_positives") == 0) & (F.col("errors") == 0) & (F.col("caught") == F.col("defects")))
