"""Deterministic checks of claims: floors with three-valued results, the router that composes them, and their records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.shared import Scratch

#: Names of a case that go with each of its quotes.
MANY = 1000
#: A floor takes cases and parameters and gives case_id and ``conforms``, null where it cannot tell.
Floor = Callable[[DataFrame, dict], DataFrame]
_FLOORS: dict[str, Floor] = {}


def floor(name: str) -> Callable[[Floor], Floor]:
    """Registers a floor under a name; a second of the same name replaces the first."""

    def add(f: Floor) -> Floor:
        _FLOORS[name] = f
        return f

    return add


def floors() -> dict[str, Floor]:
    return dict(_FLOORS)


@floor("retrieval")
def retrieval(hits: DataFrame, params: dict) -> DataFrame:
    """Null without results, else whether the best reaches ``min_score``. ``hits`` has case_id and score, null where nothing was found."""
    best = hits.groupBy("case_id").agg(F.max("score").alias("top"), F.count("score").alias("n"))
    return best.select("case_id", F.when(F.col("n") > 0, F.col("top") >= params.get("min_score", 0.5)).alias("conforms"))


@floor("knowledge")
def knowledge(hits: DataFrame, params: dict) -> DataFrame:
    """A hit at ``min_score`` or above that corroborates the claim grounds it; where absence is claimed it disproves it. Else null."""
    good = (F.col("score") >= params.get("min_score", 0.0)) & (F.col("corroborates") if params.get("match") else F.lit(True))
    found = hits.groupBy("case_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("grounded"))
    return found.select("case_id", F.when(F.col("grounded"), F.lit(params.get("expect", "present") == "present")).alias("conforms"))


@floor("structure")
def structure(checked: DataFrame, params: dict) -> DataFrame:
    """Rules over one record (name -> SQL predicate): false where any fails; null where there is no record."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in params["rules"].items()]))
    return checked.select("case_id", F.when(F.expr(params.get("present", "true")), F.size(failed) == 0).alias("conforms"), F.array_join(failed, ",").alias("failed"))


@floor("preserved")
def preserved(extractions: DataFrame, params: dict) -> DataFrame:
    """K extractions of whether a fact is stated in the source and kept in the artifact: more than half violated is false, satisfied true, else null."""
    outcome = F.when(F.col("stated") & ~F.col("kept"), "violated").when(F.col("stated") & F.col("kept"), "satisfied").otherwise("unconfirmed")
    return _majority(extractions.withColumn("outcome", outcome))


@floor("attribution")
def attribution(extractions: DataFrame, params: dict) -> DataFrame:
    """K extractions of who said a statement in the source and by the artifact: violated where both are known and differ."""
    known = lambda c: F.when(~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "unknown", "unclear", "none"), F.lower(F.trim(c)))
    a, b = known(F.col("source_speaker")), known(F.col("attributed"))
    return _majority(extractions.withColumn("outcome", F.when(a.isNull() | b.isNull(), "unconfirmed").when(a != b, "violated").otherwise("satisfied")))


def _majority(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("outcome") == "violated").alias("v"), F.count_if(F.col("outcome") == "satisfied").alias("s"))
    half = F.floor(F.col("k") / 2)
    return n.select("case_id", F.when(F.col("v") > half, False).when(F.col("s") > half, True).alias("conforms"))


@floor("subsumption")
def subsumption(terms: DataFrame, params: dict) -> DataFrame:
    """A note whose concept is a strict kind of the record's goes beyond it: false. The record's being a kind of the note's, or equal, is fine: true. Else null."""
    up = params["ancestors"].select("child", "ancestor").distinct()
    below = up.select(F.col("child").alias("note"), F.col("ancestor").alias("record"), F.lit(True).alias("below"))
    above = up.select(F.col("child").alias("record"), F.col("ancestor").alias("note"), F.lit(True).alias("above"))
    j = terms.join(below, ["note", "record"], "left").join(above, ["note", "record"], "left")
    same = F.coalesce("above", F.col("note") == F.col("record"))
    return j.select("case_id", F.when(F.col("note").isNull() | F.col("record").isNull(), None).when(F.coalesce("below", F.lit(False)) & ~same, False).when(same, True).alias("conforms"))


def all_grounded(terms: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Disproved where every candidate term of a finding is resolved and is, or is a kind of, some concept of the record.

    ``terms`` has case_id, candidate, concept (null if unresolved) and the record's concepts."""
    up = ancestors.select(F.col("child").alias("concept"), "ancestor").distinct()
    each = terms.select("case_id", "candidate", "concept", F.explode_outer("record").alias("ancestor"))
    j = each.join(up.withColumn("below", F.lit(True)), ["concept", "ancestor"], "left")
    one = j.groupBy("case_id", "candidate").agg(F.bool_or(F.coalesce(F.col("concept") == F.col("ancestor"), F.lit(False)) | F.coalesce("below", F.lit(False))).alias("held"))
    return one.groupBy("case_id").agg(F.bool_and("held").alias("disproved"), F.count(F.lit(1)).alias("candidates"))


def route(flags: DataFrame, results: DataFrame, base: str = "approve") -> DataFrame:
    """Open flags (case_id, code; a null code for a case without any) against floor results (case_id, code, conforms).

    true clears, false confirms, null or no result leaves unresolved; a case is approved if all its flags are cleared."""
    j = flags.join(results.select("case_id", "code", "conforms"), ["case_id", "code"], "left")
    state = F.when(F.col("conforms"), "CLEARED").when(~F.col("conforms"), "CONFIRMED").otherwise("UNRESOLVED")
    j = j.withColumn("state", F.when(F.col("code").isNotNull(), state))
    n = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    by = j.groupBy("case_id").agg(F.count("code").alias("flags"), n("CLEARED"), n("CONFIRMED"), n("UNRESOLVED"))
    return by.withColumn("verdict", F.when(F.col("flags") == 0, base).when(F.col("cleared") == F.col("flags"), "approve").otherwise("reject"))


def dispatch(declared: DataFrame, known: dict[str, Floor] | None = None) -> DataFrame:
    """What becomes of each declared floor (name, params as JSON, artifact): skipped without an artifact, malformed without a known name or a JSON object as parameters, else run."""
    names = list(floors() if known is None else known)
    good = F.col("name").isin(*names) & F.from_json("params", "map<string,string>").isNotNull()
    return declared.withColumn("outcome", F.when(F.col("artifact").isNull() | (F.col("artifact") == ""), "skipped").when(~F.coalesce(good, F.lit(False)), "malformed").otherwise("run"))


def audit_rows(suppressed: DataFrame, blocks: DataFrame, declared: DataFrame) -> DataFrame:
    """case_id, code, action of the declared checks that took part: suppress, floor_block, or run where a floor could not tell."""
    a = suppressed.select("case_id", "code", F.lit("suppress").alias("action"))
    b = blocks.select("case_id", "code", F.when(F.col("conforms").isNull(), "run").otherwise("floor_block").alias("action"))
    return a.unionByName(b).join(declared, "code", "left_semi").select("case_id", "code", "action")


def corrections(entries: DataFrame, votes: DataFrame, action: str) -> DataFrame:
    """A correction of each entry (case_id, code, before, after, owner): who had raised the code, with votes, in order of the judges.

    ``action`` is suppress, floor_inject or withstands; only a suppression keeps the original label."""
    raised = votes.groupBy("case_id", "code").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "role", "vote"))), ",").alias("rollout"))
    j = entries.join(raised, ["case_id", "code"], "left")
    kept = F.col("code") if action == "suppress" else F.lit(None).cast("string")
    made = F.lit(None).cast("string") if action == "suppress" else F.col("code")
    return j.select("case_id", F.lit(action).alias("action"), F.coalesce("rollout", F.lit("")).alias("rollout"), kept.alias("original_label"), made.alias("corrected_label"), "owner", F.col("before").alias("verdict_before"), F.col("after").alias("verdict_after"))


def corpus_rows(records: DataFrame, body: Column) -> DataFrame:
    """Corrections as rows of the corpus, each with the digest of its canonical body."""
    flag = F.coalesce("original_label", "corrected_label")
    return records.select("case_id", "action", flag.alias("flag_code"), "verdict_before", "verdict_after", "owner", F.sha2(body, 256).alias("rollout_ref"))


def first_disproof(findings: DataFrame, contracts: DataFrame, disproves: Column) -> DataFrame:
    """The first contract, by ordinal, of a finding's code that disproves it; null where none does. A contract that errs (null) does not end the chain."""
    j = findings.join(contracts, "code", "left")
    return j.groupBy("case_id", "role", "code").agg(F.min_by("contract", F.when(disproves, F.col("ordinal"))).alias("contract"))


def last_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings with the spans of the last evidence row of their code, null without one."""
    last = evidence.groupBy("case_id", "code").agg(F.max_by("spans", "place").alias("spans"))
    return findings.join(last, ["case_id", "code"], "left")


def linked_chunks(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Of each span the chunk of the first match of its case whose code (dots aside) or label stands in the quote as a whole token of three characters or more.

    A token is a run of letters, digits and underscores. A quote goes with the names of its case, which are MANY at most, and only
    the tokens that are names go on. Where a case has more names the join is on all tokens; no span meets every match."""
    parts = {"label": lambda c: F.split(c, r"\W+"), "code": lambda c: F.split(F.replace(c, F.lit("."), F.lit("")), r"\W+")}
    q = spans.select("case_id", "span_id", "quote")
    named = [matches.select("case_id", F.col(c).alias("token"), F.lit(c).alias("kind"), F.struct("place", F.lit(i).alias("i")).alias("rank"), F.concat_ws(":", "namespace", c).alias("chunk")).filter(f"length({c}) >= 3") for i, c in enumerate(("code", "label"))]
    scratch = Scratch(spans.sparkSession, "names")
    names = scratch.written(named[0].unionByName(named[1]))
    count = names.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    few = names.join(count.filter(F.col("n") <= MANY), "case_id", "left_semi").groupBy("case_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in parts])
    some = q.join(few, "case_id").select("case_id", "span_id", *[F.array_intersect(tokens(F.col("quote")), F.col(k)).alias(k) for k, tokens in parts.items()])
    much = q.join(count.filter(F.col("n") > MANY), "case_id", "left_semi").select("case_id", "span_id", *[F.array_distinct(tokens(F.col("quote"))).alias(k) for k, tokens in parts.items()])
    # written, as a generator of what is not written yet cuts each quote several times
    each = scratch.written(some.unionByName(much)).select("case_id", "span_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens")) for k in parts])).alias("x"))
    hit = each.select("case_id", "span_id", "x.kind", F.explode("x.tokens").alias("token")).join(names, ["case_id", "token", "kind"])
    best = hit.groupBy("span_id").agg(F.min_by("chunk", "rank").alias("chunk_id"))
    return q.select("span_id").join(best, "span_id", "left")
