"""Queries of floors, routing, linked evidence and corrections, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.hashing import uniform
from assaylake.operators import floors as op
from assaylake.operators import hierarchy
from assaylake.plans.consensus import _DISPROVED, _disproved
from assaylake.plans.text import _ISA, _isa
from assaylake.shared import Scratch, spread
from assaylake.sources import relations as r
from assaylake.sources import stores
from assaylake.sources.relations import _u, sql


def _hits(s, d):
    """Retrieval results of every case: up to four, some cases with none."""
    c = r.cases(s, d).select("case_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    key = [F.col("case_id"), F.col("k")]
    found = (uniform("found", *key) < 0.6) & (F.col("case_id") % 5 > 0)
    return c.select("case_id", "k", F.when(found, F.round(uniform("score", *key), 6)).alias("score"), (uniform("corroborate", *key) < 0.5).alias("corroborates"))


_HITS = f"""hits as (select doc_id as case_id, cast(k as integer) as k, case when {_u("'found'", 'doc_id', 'cast(k as integer)')} < 0.6 and doc_id % 5 > 0 then round({_u("'score'", 'doc_id', 'cast(k as integer)')}, 6) end as score,
  {_u("'corroborate'", 'doc_id', 'cast(k as integer)')} < 0.5 as corroborates from documents, range(0, 4) n(k))"""

RULES = {"named": "length(p_name) > 0", "sized": "p_size between 1 and 40", "priced": "p_retailprice > 905", "branded": "p_brand like 'Brand#%'"}


def _parts(s, d):
    return r.table(s, d, "part").withColumn("case_id", F.col("p_partkey"))


def _extractions(s, d):
    v = r.votes(s, d)
    return v.select("case_id", (F.col("vote") != "WARN").alias("stated"), (F.col("vote") == "PASS").alias("kept"))


def _speakers(s, d):
    v = r.votes(s, d)
    return v.select("case_id", F.when(F.col("vote") == "WARN", "Unknown").otherwise("Agent ").alias("source_speaker"), F.when(F.col("vote") == "BLOCK", "user").otherwise("agent").alias("attributed"))


def _terms(s, d):
    """A note's and a record's concept of each customer, some of them absent."""
    c = r.table(s, d, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("nation"))
    pick = F.col("case_id") % 5
    note = F.when(pick == 0, F.col("child")).when(pick == 1, F.col("nation")).when(pick == 2, F.col("child")).when(pick == 3, "r0")
    record = F.when(pick == 0, F.col("nation")).when(pick == 1, F.col("child")).otherwise(F.col("child"))
    return c.select("case_id", note.alias("note"), record.alias("record"))


def _candidates(s, d):
    """Two candidate terms of each customer against the concepts of its record."""
    c = r.table(s, d, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("nation"))
    second = F.when(F.col("case_id") % 3 == 0, F.lit("r9")).when(F.col("case_id") % 3 == 1, F.col("nation"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("candidate"), F.col("child").alias("concept")), F.struct(F.lit(1).alias("candidate"), second.alias("concept"))))
    return c.select("case_id", F.array("nation").alias("record"), each.alias("x")).select("case_id", "record", "x.*")


def _flags(s, d):
    """Open flags of every run of a case; runs without any have a null code."""
    f = r.run_findings(s, d).select("case_id", "code").distinct()
    return r.run_cases(s, d).select("case_id").join(f, "case_id", "left")


def _results(s, d):
    f = r.run_findings(s, d).select("case_id", "code").distinct()
    u = uniform("floor", F.col("case_id"), F.col("code"))
    return f.filter(u < 0.9).select("case_id", "code", F.when(u < 0.5, True).when(u < 0.7, False).alias("conforms"))


_FLOOR = f"floor_results as (select case_id, code, case when u < 0.5 then true when u < 0.7 then false end as conforms from (select distinct case_id, code, {_u(chr(39) + 'floor' + chr(39), 'case_id', 'code')} as u from run_findings) where u < 0.9)"


def _declared(s, d):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, "structure").when(k % 3 == 1, "retrieval").otherwise("unheard")
    return r.table(s, d, "documents").select("doc_id", name.alias("name"), F.when(k % 7 == 0, "[1").otherwise("{}").alias("params"), F.when(k % 4 > 0, F.substring("text", 1, 10)).alias("artifact"))


def _entries(s, d):
    gone = _disproved(s, d)
    return gone.join(r.dim_code(s).select("code", "owner"), "code").select("case_id", "code", F.lit("BLOCK").alias("before"), F.lit("PASS").alias("after"), "owner")


def _corrections(action):
    return lambda s, d: op.corrections(_entries(s, d), r.run_findings(s, d), action)


def _corrections_sql(action):
    kept, made = ("d.code", "null") if action == "suppress" else ("null", "d.code")
    return f"""select d.case_id, '{action}' as action, coalesce(v.rollout, '') as rollout, cast({kept} as varchar) as original_label, cast({made} as varchar) as corrected_label, owner, 'BLOCK' as verdict_before, 'PASS' as verdict_after from disproved d join dim_code c on d.code = c.code
      left join (select case_id, code, string_agg(distinct role || ':' || vote, ',' order by role || ':' || vote) as rollout from run_findings group by case_id, code) v on d.case_id = v.case_id and d.code = v.code"""


def _corpus(s, d):
    c = _corrections("suppress")(s, d)
    body = stores.canonical_json(case_id=F.col("case_id"), code=F.coalesce("original_label", "corrected_label"), rollout=F.col("rollout"))
    return op.corpus_rows(c, body)


def _contracts(s):
    """Contracts of a code in their order."""
    return s.createDataFrame([(c, f"{kind}_{c}", i) for c in [x[0] for x in r.CODES] for i, kind in enumerate(("presence", "source", "battery"))], "code string, contract string, ordinal int")


def _chain(s, d):
    u = uniform("contract", F.col("case_id"), F.col("role"), F.col("contract"))
    disproves = F.when(u < 0.2, None).otherwise(u < 0.5)
    return op.first_disproof(r.run_findings(s, d).select("case_id", "role", "code"), _contracts(s), disproves)


def _evidence(s, d):
    f = r.run_findings(s, d).filter("has_evidence")
    return f.select("case_id", "code", "role", F.concat_ws("-", "role", "code").alias("spans")).withColumn("place", F.col("role"))


def _quotes(s, d):
    b = spread(r.table(s, d, "documents").select(F.col("doc_id").alias("case_id"), "text"))
    words = F.filter(F.split("text", "[^A-Za-z0-9_]+", 43), lambda x: x != "")  # 41 words are among so many parts
    heads = Scratch(s, "heads").written(b.select("case_id", words.alias("w")).select("case_id", *[F.get("w", F.lit(k)).alias(f"w{k}") for k in (0, 3, 40)]))
    match = lambda i, code, label: F.struct(F.lit(i).alias("place"), F.lit("kb").alias("namespace"), code.alias("code"), label.alias("label"))
    spans = b.select("case_id", F.col("case_id").alias("span_id"), F.when(F.col("case_id") % 3 > 0, F.col("text")).otherwise("code E11.9 stands here").alias("quote"))
    matches = heads.select("case_id", F.explode(F.array(match(0, F.lit("zz"), F.lit("Nowhere_To_Be_Found")), match(1, F.lit("E119"), F.col("w40")), match(2, F.col("w3"), F.col("w0")))).alias("x")).select("case_id", "x.*")
    return op.linked_chunks(spans, matches)


QUERIES = {
    "g05_kb_grounding": (
        lambda s, d: op.knowledge(_hits(s, d), {"min_score": 0.4, "match": "claim_in_chunk"}),
        f"with {_HITS} select case_id, case when bool_or(coalesce(score >= 0.4 and corroborates, false)) then true end as conforms from hits group by case_id",
    ),
    "g05_kb_absent": (
        lambda s, d: op.knowledge(_hits(s, d), {"min_score": 0.6, "expect": "absent"}),
        f"with {_HITS} select case_id, case when bool_or(coalesce(score >= 0.6, false)) then false end as conforms from hits group by case_id",
    ),
    "g08_all_terms_grounded": (
        lambda s, d: op.all_grounded(_candidates(s, d), hierarchy.closure(_isa(s, d))),
        "select c_custkey as case_id, c_custkey % 3 = 1 as disproved, cast(2 as bigint) as candidates from customer",
    ),
    "g11_structure": (
        lambda s, d: op.structure(_parts(s, d), {"rules": RULES, "present": "p_partkey % 10 > 0"}),
        f"with k as (select p_partkey, list_filter([{', '.join(f'case when not coalesce({x}, false) then {chr(39)}{n}{chr(39)} end' for n, x in RULES.items())}], lambda x: x is not null) as f from part) select p_partkey as case_id, case when p_partkey % 10 > 0 then len(f) = 0 end as conforms, array_to_string(f, ',') as failed from k",
    ),
    "g12_fact_preservation": (
        lambda s, d: op.preserved(_extractions(s, d), {}),
        sql("select case_id, case when count(*) filter (vote = 'BLOCK') > count(*) // 2 then false when count(*) filter (vote = 'PASS') > count(*) // 2 then true end as conforms from votes group by case_id", "votes"),
    ),
    "g12_speaker_attribution": (
        lambda s, d: op.attribution(_speakers(s, d), {}),
        sql("select case_id, case when count(*) filter (vote = 'BLOCK') > count(*) // 2 then false when count(*) filter (vote = 'PASS') > count(*) // 2 then true end as conforms from votes group by case_id", "votes"),
    ),
    "g13_subsumption_floor": (
        lambda s, d: op.subsumption(_terms(s, d), {"ancestors": hierarchy.closure(_isa(s, d))}),
        sql(
            f"""with {_ISA}, t as (select c_custkey as case_id, case c_custkey % 5 when 0 then 'c' || c_custkey when 1 then 'n' || c_nationkey when 2 then 'c' || c_custkey when 3 then 'r0' end as note,
            case c_custkey % 5 when 0 then 'n' || c_nationkey else 'c' || c_custkey end as record from customer)
            select case_id, case when note is null then null when note = record or exists (select 1 from up where child = record and ancestor = note) then true when exists (select 1 from up where child = note and ancestor = record) then false end as conforms from t"""
        ),
    ),
    "g14_record_rag": (lambda s, d: op.retrieval(_hits(s, d), {}), f"with {_HITS} select case_id, case when count(score) > 0 then max(score) >= 0.5 end as conforms from hits group by case_id"),
    "g15_router": (
        lambda s, d: op.route(_flags(s, d), _results(s, d)),
        sql(
            f"""with {_FLOOR}, f as (select distinct v.case_id, g.code from run_votes v left join run_findings g on v.case_id = g.case_id),
            n as (select f.case_id, count(f.code) as flags, count(*) filter (conforms) as cleared, count(*) filter (not conforms) as confirmed, count(*) filter (f.code is not null and conforms is null) as unresolved
              from f left join floor_results x on f.case_id = x.case_id and f.code = x.code group by f.case_id)
            select *, case when flags = 0 or cleared = flags then 'approve' else 'reject' end as verdict from n""",
            "run_votes",
            "run_findings",
        ),
    ),
    "g16_dispatch": (
        lambda s, d: op.dispatch(_declared(s, d)).groupBy("name", "outcome").agg(F.count(F.lit(1)).alias("n")),
        """select case doc_id % 3 when 0 then 'structure' when 1 then 'retrieval' else 'unheard' end as name, case when doc_id % 4 = 0 or text = '' then 'skipped' when doc_id % 3 = 2 or doc_id % 7 = 0 then 'malformed' else 'run' end as outcome, count(*) as n from documents group by 1, 2""",
    ),
    "g18_audit_rows": (
        lambda s, d: op.audit_rows(_disproved(s, d), _results(s, d).filter("conforms is null or not conforms"), r.dim_code(s).filter("tier = 1").select("code")),
        sql(
            f"""with {_DISPROVED}, {_FLOOR}, a as (select case_id, code, 'suppress' as action from disproved union all select case_id, code, case when conforms is null then 'run' else 'floor_block' end from floor_results where conforms is null or not conforms)
            select * from a where code in (select code from dim_code where tier = 1)""",
            "run_findings",
        ),
    ),
    "g19_suppress": (_corrections("suppress"), sql(f"with {_DISPROVED} {_corrections_sql('suppress')}", "run_findings")),
    "g19_floor_inject": (_corrections("floor_inject"), sql(f"with {_DISPROVED} {_corrections_sql('floor_inject')}", "run_findings")),
    "g19_withstands": (_corrections("withstands"), sql(f"with {_DISPROVED} {_corrections_sql('withstands')}", "run_findings")),
    "d07_corpus_rows": (
        _corpus,
        sql(
            f"""with {_DISPROVED}, c as ({_corrections_sql('suppress')}) select case_id, action, original_label as flag_code, verdict_before, verdict_after, owner,
            sha256('{{"case_id": "' || case_id || '", "code": "' || original_label || '", "rollout": "' || rollout || '"}}') as rollout_ref from c""",
            "run_findings",
        ),
    ),
    "j07_first_disproof": (
        _chain,
        sql(
            f"""with k as (select distinct case_id, role, code from run_findings), c as (select *, case i when 0 then 'presence_' when 1 then 'source_' else 'battery_' end || code as contract from k, range(0, 3) n(i)),
            x as (select *, {_u("'contract'", 'case_id', 'role', 'contract')} as u from c)
            select case_id, role, code, arg_min(contract, i) filter (u >= 0.2 and u < 0.5) as contract from x group by case_id, role, code""",
            "run_findings",
        ),
    ),
    "j08_last_evidence": (
        lambda s, d: op.last_evidence(r.run_findings(s, d).select("case_id", "code").distinct(), _evidence(s, d)),
        sql("select case_id, code, max(role || '-' || code) filter (has_evidence) as spans from run_findings group by case_id, code", "run_findings"),
    ),
    "j09_linked_chunks": (
        _quotes,
        """with d as (select doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+') as w, case when doc_id % 3 > 0 then text else 'code E11.9 stands here' end as quote from documents),
            t as (select doc_id, w, regexp_split_to_array(quote, '[^A-Za-z0-9_]+') as plain, regexp_split_to_array(replace(quote, '.', ''), '[^A-Za-z0-9_]+') as coded from d)
            select doc_id as span_id, case when list_contains(plain, 'Nowhere_To_Be_Found') then 'kb:Nowhere_To_Be_Found' when list_contains(coded, 'E119') then 'kb:E119' when length(w[41]) >= 3 and list_contains(plain, w[41]) then 'kb:' || w[41]
            when length(w[4]) >= 3 and list_contains(coded, w[4]) then 'kb:' || w[4] when length(w[1]) >= 3 and list_contains(plain, w[1]) then 'kb:' || w[1] end as chunk_id from t""",
    ),
}
