"""Queries of record predicates and configuration joins, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.hashing import uniform
from assaylake.operators import records as op
from assaylake.plans.consensus import _SEVERITY
from assaylake.plans.scorecard import _lens
from assaylake.sources import relations as r
from assaylake.sources.relations import _u, sql

_LENS = "lens as (select role, code from dim_role, dim_code where owner = '' or owner = role)"
_WORDS = ("approve", "reject", "needs_review", "PASS", "Fail", "odd")


def _raw(s, d):
    """Documents with a verdict word and a model name that follow their ids."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    model = F.concat(F.lit("m-"), F.when(F.col("doc_id") % 3 == 0, "2024-05-13").when(F.col("doc_id") % 3 == 1, "latest").otherwise("20240513"))
    return r.table(s, d, "documents").select("doc_id", F.element_at(words, (F.col("doc_id") % len(_WORDS) + 1).cast("int")).alias("verdict"), model.alias("model"))


_RAW = f"""raw as (select doc_id, list_extract([{', '.join(f"'{w}'" for w in _WORDS)}], cast(doc_id % {len(_WORDS)} + 1 as integer)) as verdict,
  'm-' || case doc_id % 3 when 0 then '2024-05-13' when 1 then 'latest' else '20240513' end as model from documents)"""


def _spoiled(s, d):
    """Votes, some with faults."""
    u = uniform("spoil", F.col("case_id"), F.col("role"))
    v = r.run_votes(s, d)
    return v.select("case_id", "role", "run", F.when(u < 0.1, "MAYBE").otherwise(F.col("vote")).alias("vote"), F.when((u > 0.1) & (u < 0.2), F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"), F.when(u > 0.9, " ").otherwise("fine").alias("summary"))


_US = _u("'spoil'", "case_id", "role")
_SPOILED = f"""spoiled as (select case_id, role, run, case when {_US} < 0.1 then 'MAYBE' else vote end as vote, case when {_US} > 0.1 and {_US} < 0.2 then 1.5 else confidence end as confidence,
  case when {_US} > 0.9 then ' ' else 'fine' end as summary from run_votes)"""


def _lens_of_languages(s, d):
    """The judges' codes in each language: those that they own, and those that are assigned as they raised them with evidence where they passed a case."""
    c = r.cases(s, d).select("case_id", "lang")
    owned = c.select("lang").distinct().crossJoin(F.broadcast(_lens(s).select("role", "code")))
    assigned = r.findings(s, d).filter("has_evidence and vote = 'PASS'").select("case_id", "role", "code").join(c, "case_id")
    return op.effective_lens(owned, assigned, ["lang"])


def _flags(s, d, role):
    """A judge's verdict and flags of every run, as a backend's."""
    f = r.run_findings(s, d).filter(F.col("role") == role).groupBy("case_id").agg(F.collect_set("code").alias("flags"))
    v = r.run_votes(s, d).filter(F.col("role") == role).select("case_id", F.col("vote").alias("verdict"))
    return v.join(f, "case_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def _spans(s, d):
    t = r.turns(s, d)
    spans = t.filter("turn > 0").select(F.concat_ws("-", "conv_id", "turn").alias("span_id"), "conv_id", F.array(F.lit("x"), (F.col("turn") + 90).cast("string"), (F.col("turn") - 1).cast("string")).alias("turn_ids"))
    return spans, t.select("conv_id", "turn", F.col("latency_ms").alias("start_ms"))


def _log(s, d):
    return r.run_log(s, d)


QUERIES = {
    "p04_blocked": (
        lambda s, d: _raw(s, d).select("doc_id", op.blocked(F.col("verdict")).alias("blocked"), op.normalized_verdict(F.col("verdict")).alias("verdict"), op.dated_model(F.col("model")).alias("dated")),
        f"""with {_RAW} select doc_id, upper(trim(verdict)) in ('BLOCK', 'FAIL', 'REJECT') as blocked, case when lower(verdict) in ('pass', 'approve') then 'PASS' when lower(verdict) in ('warn', 'needs_review') then 'WARN'
            when lower(verdict) in ('block', 'fail', 'reject') then 'BLOCK' end as verdict, regexp_matches(model, '(-|@)[0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}}$') as dated from raw""",
    ),
    "p08_role_relevant": (
        lambda s, d: op.role_relevant(r.cases(s, d), r.gold_codes(s, d), _lens(s)),
        sql(
            f"""with {_LENS}, a as (select distinct role, case_id from gold_codes join lens using (code)), b as (select role, case_id from cases, dim_role where case_id not in (select case_id from gold_codes))
            select role, count(*) as cases from (select * from a union all select * from b) group by role""",
            "dim_role",
            "cases",
            "gold_codes",
        ),
    ),
    "p12_vote_errors": (
        lambda s, d: op.vote_errors(_spoiled(s, d)),
        sql(
            f"""with {_SPOILED}, e as (select case_id, role, run, list_filter([case when vote not in ('PASS', 'WARN', 'BLOCK') then 'decision' end, case when confidence < 0 or confidence > 1 then 'confidence' end,
            case when trim(summary) = '' then 'summary' end], lambda x: x is not null) as e from spoiled) select case_id, role, run, array_to_string(e, ',') as errors, len(e) = 0 as usable from e""",
            "run_votes",
        ),
    ),
    "p16_taxonomy_lint": (
        lambda s, d: op.taxonomy_lint(r.cases(s, d).select("case_id", (F.col("case_id") % 2 == 0).alias("declared_block")), r.gold_codes(s, d), r.dim_code(s).filter("code <> 'format'")),
        sql("select case_id, code, 'D1' as rule from gold_codes where code = 'format' union all select case_id, code, 'D8' from gold_codes join dim_code using (code) where tier = 1 and case_id % 2 <> 0", "gold_codes"),
    ),
    "p17_readiness": (
        lambda s, d: op.readiness(r.dim_code(s), _lens(s).filter("code <> 'style'"), r.findings(s, d).filter("code <> 'tone'").select("code").distinct()),
        sql(
            """with o as (select distinct code from findings where code <> 'tone') select 'no_owner' as "check", code, 'warn' as severity from dim_code where owner = '' union all select 'no_lens', 'style', 'error'
            union all select 'never_raised', code, 'info' from dim_code anti join o using (code) where gradeable""",
            "findings",
        ),
    ),
    "p20_incomplete_envelopes": (
        lambda s, d: op.incomplete_envelopes(r.table(s, d, "events").select("event_id", "props"), "props", ["k", "j"]).select("event_id", "missing"),
        "select event_id, array_to_string(list_filter([case when coalesce(json_extract_string(props, '$.k'), '') = '' then 'k' end, case when coalesce(json_extract_string(props, '$.j'), '') = '' then 'j' end], lambda x: x is not null), ',') as missing from events where coalesce(json_extract_string(props, '$.k'), '') = '' or coalesce(json_extract_string(props, '$.j'), '') = ''",
    ),
    "p26_cache_replay": (
        lambda s, d: op.cache_replay(r.table(s, d, "events").select("event_id", (F.col("event_type") == "purchase").alias("paid"), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 3).alias("tokens"))).select("event_id", "suspicious"),
        "select event_id, coalesce(event_type = 'purchase' and case when user_id % 5 > 0 then user_id % 3 end = 0, false) as suspicious from events",
    ),
    "u06_effective_lens": (
        _lens_of_languages,
        sql(f"with {_LENS} select distinct lang, role, code from cases, lens union select lang, role, code from findings join cases using (case_id) where has_evidence and vote = 'PASS'", "findings", "cases"),
    ),
    "u07_roster": (
        lambda s, d: op.roster(["user", "assistant"], r.table(s, d, "conversations")),
        "select cast(row_number() over (order by case role when 'user' then 0 when 'assistant' then 1 else 2 end, role) - 1 as integer) as place, role from (select distinct role from conversations)",
    ),
    "u10_family_closure": (
        lambda s, d: op.family_closure(r.gold_codes(s, d), r.dim_code(s)),
        sql("select case_id, code from gold_codes union select g.case_id, b.code from gold_codes g join dim_code a on g.code = a.code join dim_code b on a.family = b.family and a.family <> ''", "gold_codes"),
    ),
    "c06_judge_signals": (
        lambda s, d: op.judge_signals(r.run_findings(s, d), _lens(s), s.createDataFrame(list(r.SEVERITY), "severity string, weight double")),
        sql(f"with {_LENS}, {_SEVERITY} select distinct f.case_id, f.role, f.code, f.tier, s.weight, l.code is not null as in_lens from run_findings f left join lens l on f.role = l.role and f.code = l.code join severity s on f.severity = s.severity", "run_findings"),
    ),
    "c12_worst_of": (
        lambda s, d: op.worst_of(_flags(s, d, "risk"), _flags(s, d, "policy")),
        sql(
            """with v as (select case_id, max(case vote when 'BLOCK' then 2 when 'WARN' then 1 else 0 end) as w from run_votes where role in ('risk', 'policy') group by case_id),
            g as (select case_id, string_agg(distinct code, ',' order by code) as flags from run_findings where role in ('risk', 'policy') group by case_id)
            select v.case_id, case w when 2 then 'BLOCK' when 1 then 'WARN' else 'PASS' end as verdict, coalesce(flags, '') as flags from v left join g on v.case_id = g.case_id""",
            "run_votes",
            "run_findings",
        ),
    ),
    "a44_ensemble": (
        lambda s, d: op.ensemble(r.run_votes(s, d)),
        sql(
            """with n as (select case_id, count(*) as members, count(*) filter (vote = 'BLOCK') as rejects, string_agg(distinct role, ',' order by role) filter (vote = 'BLOCK') as b from run_votes group by case_id)
            select case_id, members, rejects, case when rejects * 2 > members then 'BLOCK' else 'PASS' end as verdict, case when rejects * 2 > members then b else '' end as rejecting from n""",
            "run_votes",
        ),
    ),
    "w05_ledger": (
        lambda s, d: op.ledger(_log(s, d).select("case_key", "seq", "verdict"), "case_key", "seq").selectExpr("case_key", "seq", "verdict", "cast(entry as bigint) as entry", "current"),
        sql("select case_key, seq, verdict, row_number() over w as entry, lead(seq) over w is null as current from run_log window w as (partition by case_key order by seq)", "run_log"),
    ),
    "j10_turn_segments": (
        lambda s, d: op.turn_segments(*_spans(s, d)),
        sql("select a.conv_id || '-' || a.turn as span_id, coalesce(min(c.latency_ms), min(b.latency_ms)) as start_ms from turns a left join turns b on a.conv_id = b.conv_id and b.turn = a.turn - 1 left join turns c on a.conv_id = c.conv_id and c.turn = a.turn + 90 where a.turn > 0 group by a.conv_id, a.turn", "turns"),
    ),
    "j13_latest_judgement": (
        lambda s, d: op.latest_judgement(_log(s, d).filter("agent = 'click'").select("seq", "case_key", "verdict"), _log(s, d).filter("agent = 'view'"), _log(s, d).filter("agent = 'signup'").groupBy("case_key").agg(F.min("verdict").alias("gold"))),
        sql(
            """select r.seq, r.case_key, r.verdict, g.gold, j.judgement from run_log r left join (select case_key, min(verdict) as gold from run_log where agent = 'signup' group by case_key) g on r.case_key = g.case_key
            left join (select case_key, arg_max(verdict, seq) as judgement from run_log where agent = 'view' group by case_key) j on r.case_key = j.case_key where r.agent = 'click'""",
            "run_log",
        ),
    ),
    "a41_optimizer_delta": (
        lambda s, d: op.mean_delta(*(r.run_log(s, d).filter(f"agent = '{a}'").groupBy("case_key").agg(F.round(F.avg("value"), 4).alias("x")) for a in ("click", "view")), "case_key", "x"),
        sql("select a.case_key, round(b.x - a.x, 4) as delta from (select case_key, round(avg(value), 4) as x from run_log where agent = 'click' group by case_key) a join (select case_key, round(avg(value), 4) as x from run_log where agent = 'view' group by case_key) b on a.case_key = b.case_key", "run_log"),
    ),
    "a24_template_score": (
        lambda s, d: op.template_score(r.votes(s, d).selectExpr("role as template", "if(gold_block, 'BLOCK', 'PASS') as expected", "if(vote = 'WARN', null, vote) as observed")),
        sql(
            """with n as (select role as template, count(*) filter (not gold_block and vote = 'BLOCK') as false_positives, count(*) filter (vote = 'WARN') as errors, count(*) filter (gold_block and vote = 'BLOCK') as caught, count(*) filter (gold_block) as defects from votes group by role)
            select *, false_positives = 0 and errors = 0 and caught = defects as accepted from n""",
            "votes",
        ),
    ),
}
