"""Queries of consensus and gates and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.hashing import uniform
from assaylake.operators import consensus as op
from assaylake.plans.scorecard import _lens
from assaylake.sources import relations as r
from assaylake.sources.relations import _u, sql

def _tiers_sql(findings: str, votes: str) -> str:
    return f"""one as (select case_id, code, role, bool_or(has_evidence) as evidence, any_value(tier) as tier, any_value(pillar) as pillar, any_value(owner) as owner from {findings} group by case_id, code, role),
  b as (select case_id, code, any_value(tier) as tier, any_value(pillar) as pillar, count(*) as judges, count(*) filter (evidence) as with_evidence, bool_or(evidence and (owner = '' or owner = role)) as owned, min(role) as role from one group by case_id, code),
  tiers as (select case_id, code, tier, pillar, judges, with_evidence, case tier
    when 1 then case when judges >= 2 and with_evidence >= 2 then 'triggered' when judges = 1 and owned then 'triggered' else 'flagged' end
    when 2 then case when judges >= 2 then 'triggered' else 'flagged' end else case when judges >= 2 then 'corroborated' else 'listed' end end as state from b
    where not (code = 'privacy_leak' and judges = 1 and not exists (select 1 from {votes} v where v.case_id = b.case_id and v.role <> b.role and v.vote <> 'PASS')))"""


_PILLARS = """pillars as (select case_id, pillar, case when bool_or(state = 'triggered') then 2 when bool_or(state in ('flagged', 'corroborated')) then 1 else 0 end as r
    from (select case_id, state, unnest(case pillar when 'dual' then ['artifact', 'conversation'] else [pillar] end) as pillar from tiers) group by case_id, pillar)"""
_TIERS = _tiers_sql("run_findings", "run_votes")
_NAME = "case {} when 2 then 'BLOCK' when 1 then 'WARN' else 'PASS' end"
_RANK = "case vote when 'BLOCK' then 2 when 'WARN' then 1 else 0 end"
_USABLE = f"{_u(chr(39) + 'usable' + chr(39), 'case_id', 'role')} < 0.85"
_COMPOSED = f"""select case_id, case when bool_or(role = 'faithfulness' and vote = 'PASS') and not bool_or(role <> 'faithfulness' and vote = 'BLOCK') then 0 else max({_RANK}) end as r from {{}} group by case_id"""
_CONSENSUS = f"""good as (select * from run_votes where {_USABLE}), held as (select f.* from run_findings f semi join good using (case_id, role)), {_tiers_sql('held', 'good')}, {_PILLARS},
  v as (select case_id, count(*) as valid, greatest(count(*) filter (vote = 'BLOCK'), count(*) filter (vote = 'WARN'), count(*) filter (vote = 'PASS')) as majority, coalesce(avg(confidence), 0.0) as mean from good group by case_id),
  t as (select case_id, count(*) filter (tier = 1 and state = 'triggered') as tier1 from tiers group by case_id), e as (select case_id, max(r) as evidence, coalesce(max(r) filter (pillar = 'artifact'), 0) as artifact from pillars group by case_id),
  c as ({_COMPOSED.format('good')}), j as (select a.case_id, coalesce(valid, 0) as valid, majority, coalesce(mean, 0.0) as mean, coalesce(tier1, 0) as tier1, coalesce(evidence, 0) as evidence, coalesce(artifact, 0) as artifact, c.r
    from (select distinct case_id from run_votes) a left join v using (case_id) left join t using (case_id) left join e using (case_id) left join c using (case_id)),
  final as (select case_id, valid, case when valid >= 2 then tier1 else 0 end as tier1, case when valid < 2 then 'WARN' else {_NAME.format('greatest(case when tier1 > 0 then evidence else r end, artifact)')} end as verdict,
    case when valid >= 2 then round(mean, 3) else 0.0 end as confidence, valid >= 2 and majority >= 2 as consensus, valid < 2 or majority < 2 or mean < 0.6 as uncertain,
    case when valid < 2 then 'insufficient_valid_models' when mean < 0.6 then 'low_confidence' end as reason from j)"""
_DISPROVED = f"disproved as (select distinct case_id, code from run_findings where {_u(chr(39) + 'disprove' + chr(39), 'case_id', 'code')} < 0.25)"
_SEVERITY = "severity as (select * from (values ('HIGH', 1.0::double), ('MEDIUM', 0.5::double), ('LOW', 0.2::double)) s(severity, weight))"
_BUCKETS = f"""{_DISPROVED}, {_SEVERITY}, buckets as (select f.case_id, f.role, f.code, f.severity, s.weight, case when not gradeable then 'skipped_non_gradeable' when d.code is not null then 'suppressed'
    when not has_evidence then 'ungrounded' else 'active' end as bucket from run_findings f left join disproved d on f.case_id = d.case_id and f.code = d.code left join severity s on f.severity = s.severity)"""
_W = "coalesce(max(weight) filter (bucket {}), 0.0)"
_VERDICT = "case when {0} >= 0.5 then 'BLOCK' when {0} > 0.0 then 'WARN' else 'PASS' end"

_OUTCOME = "bool_or(role = 'risk' and {0} = 'BLOCK') then 'CRITICAL' when bool_or(role = 'policy' and {0} = 'BLOCK') then 'POLICY_VIOLATION' when bool_or({0} = 'BLOCK') then 'FLAGGED' when bool_or(role = 'risk' and {0} = 'WARN') then 'RISK_FLAG' when bool_or({0} = 'WARN') then 'NEEDS_REVIEW' else 'CLEAR' end"
_GRADE = f"""{_DISPROVED}, {_SEVERITY}, lens as (select role, code from dim_role, dim_code where owner = '' or owner = role), spans as (select * from run_findings where has_evidence),
  l as (select f.* from spans f anti join disproved using (case_id, code)), i as (select l.* from l join lens using (role, code)), o as (select l.* from l anti join lens using (role, code)),
  kept as (select case_id, role from i union select case_id, role from o semi join i using (case_id, code)), raised as (select distinct case_id, role from spans),
  decided as (select v.case_id, v.role, case when v.vote = 'BLOCK' and (v.case_id, v.role) in (select (case_id, role) from raised) and (v.case_id, v.role) not in (select (case_id, role) from kept) then 'PASS' else v.vote end as decision from run_votes v),
  named as (select case_id, case when {_OUTCOME.format('decision')} as outcome from decided group by case_id), {_tiers_sql('spans', 'run_votes')},
  reported as (select t.case_id, t.code, d.code is not null as gone, case when state = 'triggered' and tier < 3 then 1.0 else 0.5 end::double as weight from tiers t left join disproved d on t.case_id = d.case_id and t.code = d.code),
  by_case as (select case_id, count(*) as n_findings, count(*) filter (gone) as n_suppressed, coalesce(string_agg(code, ',' order by code) filter (not gone), '') as active, max(weight) filter (not gone) as now, max(weight) as before from reported group by case_id),
  base as (select n.case_id, outcome, case when outcome in ('CRITICAL', 'POLICY_VIOLATION', 'FLAGGED') then 'BLOCK' when outcome = 'CLEAR' then 'PASS' else 'WARN' end as verdict, coalesce(n_findings, 0) as n_findings, coalesce(n_suppressed, 0) as n_suppressed,
    coalesce(active, '') as active, now, before from named n left join by_case b on n.case_id = b.case_id),
  ground as (select *, case when n_suppressed > 0 and now is null then 'PASS' else verdict end as grounded from base),
  grades as (select case_id, outcome, verdict, n_findings, n_suppressed, active, grounded, case when before >= 0.5 then 'BLOCK' when before > 0 then 'WARN' else 'PASS' end as counterfactual,
    case when grounded = 'PASS' then 'allow' when grounded = 'WARN' then 'regenerate' when coalesce(now >= 1.0, false) then 'escalate' else 'regenerate' end as decision from ground)"""


def _votes(s, d):
    return r.run_votes(s, d)


def _usable(s, d):
    """Votes, of which some are not usable."""
    return _votes(s, d).withColumn("usable", uniform("usable", F.col("case_id"), F.col("role")) < 0.85)


def _severity(s):
    return s.createDataFrame(list(r.SEVERITY), "severity string, weight double")


def _worded(s, d):
    """Votes in several vocabularies; some are no verdict, and some cases have none at all."""
    u = uniform("word", F.col("case_id"), F.col("role"))
    word = F.when(F.col("case_id") % 7 == 0, "?").when(u < 0.1, "abstain").when(u < 0.4, F.when(F.col("vote") == "BLOCK", "reject").when(F.col("vote") == "WARN", "needs_review").otherwise("approve")).otherwise(F.col("vote"))
    return _votes(s, d).select("case_id", "role", word.alias("vote"))


def _validated(s, d):
    """Results of a validator for every document: some skipped, some failed, some without a verdict."""
    k = F.col("doc_id")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("critical", "low", "odd")]), (k % 3 + 1).cast("int"))
    return r.table(s, d, "documents").select(
        k.alias("case_id"),
        F.when(k % 11 > 0, F.when(k % 2 == 0, "BLOCK").otherwise("PASS")).alias("verdict"),
        F.when(k % 7 == 0, "no profile").alias("skipped"),
        F.when(k % 13 == 0, F.concat(F.lit("timeout "), k)).alias("error"),
        F.when((k % 2 == 0) & (k % 5 > 0), raw).alias("severity"),
        F.when((k % 2 == 0) & (k % 4 == 0), "field missing").alias("detail"),
    )


def _grades(s, d):
    return op.grade(_votes(s, d), r.run_findings(s, d), _disproved(s, d), _lens(s), _severity(s))


def _disproved(s, d):
    f = r.run_findings(s, d)
    return f.filter(uniform("disprove", F.col("case_id"), F.col("code")) < 0.25).select("case_id", "code").distinct()


def _buckets(s, d):
    return op.ground_findings(r.run_findings(s, d), _disproved(s, d), _severity(s))


def _stages(s, d):
    """Structural, semantic and artifact verdicts: the votes of three judges taken as stages."""
    ordinal = F.when(F.col("role") == "policy", 0).when(F.col("role") == "risk", 1).otherwise(2)
    return _votes(s, d).select("case_id", F.col("role").alias("stage"), ordinal.alias("ordinal"), F.col("vote").alias("verdict"))


QUERIES = {
    "c02_tier_rules": (lambda s, d: op.code_tiers(r.run_findings(s, d), _votes(s, d)), sql(f"with {_TIERS} select * from tiers", "run_votes", "run_findings")),
    "c02_pillars": (
        lambda s, d: op.pillar_verdicts(op.code_tiers(r.run_findings(s, d), _votes(s, d))),
        sql(
            f"""with {_TIERS}, p as (select case_id, state, unnest(case pillar when 'dual' then ['artifact', 'conversation'] else [pillar] end) as pillar from tiers)
            select case_id, pillar, case when bool_or(state = 'triggered') then 'BLOCK' when bool_or(state in ('flagged', 'corroborated')) then 'WARN' else 'PASS' end as verdict from p group by case_id, pillar""",
            "run_votes",
            "run_findings",
        ),
    ),
    "c02_verdict": (lambda s, d: op.consensus(_usable(s, d), r.run_findings(s, d)), sql(f"with {_CONSENSUS} select * from final", "run_votes", "run_findings")),
    "c04_outcome": (
        lambda s, d: op.case_outcomes(r.votes(s, d)),
        sql(
            """with q as (select case_id, role, vote, count(*) as c, min(run) as seen from votes group by case_id, role, vote),
            m as (select case_id, role, vote as decision from (select *, row_number() over (partition by case_id, role order by c desc, seen) as k from q) where k = 1),
            s as (select case_id, role, round(var_pop(case vote when 'BLOCK' then 0.0::double when 'WARN' then 0.5::double else 1.0::double end), 6) as variance from votes group by case_id, role)
            select m.case_id, case when bool_or(variance >= 0.20) then 'NEEDS_REVIEW' when bool_or(m.role = 'risk' and decision = 'BLOCK') then 'CRITICAL' when bool_or(m.role = 'policy' and decision = 'BLOCK') then 'POLICY_VIOLATION'
            when bool_or(decision = 'BLOCK') then 'FLAGGED' when bool_or(m.role = 'risk' and decision = 'WARN') then 'RISK_FLAG' when bool_or(decision = 'WARN') then 'NEEDS_REVIEW' else 'CLEAR' end as outcome
            from m join s on m.case_id = s.case_id and m.role = s.role group by m.case_id""",
            "votes",
        ),
    ),
    "c07_withstands": (
        lambda s, d: op.withstands(_votes(s, d), r.run_findings(s, d), _disproved(s, d), _lens(s)),
        sql(
            f"""with {_DISPROVED}, lens as (select role, code from dim_role, dim_code where owner = '' or owner = role), f as (select case_id, role, code from run_findings),
            l as (select f.* from f anti join disproved using (case_id, code)), i as (select l.* from l join lens using (role, code)),
            o as (select l.* from l anti join lens using (role, code)), k as (select case_id, role from i union all select case_id, role from o semi join i using (case_id, code))
            select v.case_id, v.role, v.vote, coalesce(h.n, 0) as raised, coalesce(k.n, 0) as kept, case when v.vote = 'BLOCK' and coalesce(h.n, 0) > 0 and coalesce(k.n, 0) = 0 then 'PASS' else v.vote end as decision
            from run_votes v left join (select case_id, role, count(*) as n from f group by all) h on v.case_id = h.case_id and v.role = h.role
            left join (select case_id, role, count(*) as n from k group by all) k on v.case_id = k.case_id and v.role = k.role""",
            "run_votes",
            "run_findings",
        ),
    ),
    "c10_gate_decision": (
        lambda s, d: op.gate_decisions(op.consensus(_usable(s, d), r.run_findings(s, d)), r.run_findings(s, d)),
        sql(
            f"""with {_CONSENSUS}, h as (select case_id, bool_or(severity = 'HIGH') as high from run_findings group by case_id)
            select f.case_id, verdict, case when verdict = 'PASS' then 'allow' when verdict = 'WARN' then 'regenerate' when coalesce(high, false) then 'escalate' else 'regenerate' end as decision
            from final f left join h on f.case_id = h.case_id""",
            "run_votes",
            "run_findings",
        ),
    ),
    "w17_stage_attribution": (
        lambda s, d: op.stage_attribution(_stages(s, d)),
        sql(
            """with s as (select case_id, role as stage, case role when 'policy' then 0 when 'risk' then 1 else 2 end as ordinal, case vote when 'BLOCK' then 2 when 'WARN' then 1 else 0 end as rank from run_votes)
            select case_id, stage, rank from (select *, row_number() over (partition by case_id order by rank desc, ordinal) as k from s) where k = 1""",
            "run_votes",
        ),
    ),
    "g01_buckets": (lambda s, d: _buckets(s, d), sql(f"with {_BUCKETS} select * from buckets", "run_votes", "run_findings")),
    "a43_coverage": (lambda s, d: op.coverage_counts(_buckets(s, d)), sql(f"with {_BUCKETS} select bucket, count(*) as n, count(distinct case_id) as cases from buckets group by bucket", "run_votes", "run_findings")),
    "u08_rescore": (
        lambda s, d: op.rescore(_buckets(s, d)),
        sql(
            f"""with {_BUCKETS} select case_id, count(*) filter (bucket = 'suppressed') as suppressed, {_VERDICT.format(_W.format("= 'active'"))} as verdict,
            {_VERDICT.format(_W.format("in ('active', 'suppressed')"))} as counterfactual from buckets group by case_id""",
            "run_votes",
            "run_findings",
        ),
    ),
    "c03_composition": (lambda s, d: op.composed(_votes(s, d)), sql(f"with c as ({_COMPOSED.format('run_votes')}) select case_id, {_NAME.format('r')} as verdict from c", "run_votes")),
    "c05_outcome_from_votes": (
        lambda s, d: op.outcomes_from_votes(_worded(s, d)),
        sql(
            f"""with w as (select case_id, role, case when case_id % 7 = 0 then null when {_u("'word'", 'case_id', 'role')} < 0.1 then null else vote end as x from run_votes)
            select case_id, case when count(x) = 0 then null when {_OUTCOME.format('x')} as outcome from w group by case_id""",
            "run_votes",
        ),
    ),
    "c08_stage_findings": (
        lambda s, d: op.stage_findings(op.code_tiers(r.run_findings(s, d), _votes(s, d)), r.run_findings(s, d)),
        sql(
            f"""with {_TIERS}, f as (select case_id, code, min(role) as judge from run_findings where has_evidence group by case_id, code)
            select t.case_id, t.code, case when state = 'triggered' and tier < 3 then 'HIGH' else 'MEDIUM' end as severity, t.code || ' (judges=' || judges || ')' as detail, judge from tiers t left join f on t.case_id = f.case_id and t.code = f.code""",
            "run_votes",
            "run_findings",
        ),
    ),
    "c11_stage_results": (
        lambda s, d: op.stage_results(_validated(s, d)),
        """with k as (select doc_id as k, doc_id % 13 = 0 as bad, doc_id % 11 = 0 or doc_id % 7 = 0 as off, doc_id % 2 = 0 and (doc_id % 5 > 0 or doc_id % 4 = 0) as found from documents)
            select k as case_id, case when bad then 'WARN' when off then 'not_applicable' when k % 2 = 0 then 'BLOCK' else 'PASS' end as status,
            case when bad then 'MEDIUM' when not off and found then case when k % 5 = 0 then 'MEDIUM' else (['HIGH', 'LOW', 'MEDIUM'])[k % 3 + 1] end end as severity,
            case when bad then 'structural_validation_error: timeout ' || k when not off and found then case when k % 4 = 0 then 'field missing' else 'structural check failed' end end as detail from k""",
    ),
    "c09_vote_rows": (
        lambda s, d: op.vote_rows(_votes(s, d), r.run_findings(s, d)),
        sql(
            """with c as (select case_id, role, string_agg(distinct code, ', ' order by code) as codes from run_findings group by case_id, role)
            select v.case_id, v.role, vote, confidence, coalesce(case vote when 'BLOCK' then 'reject' when 'WARN' then 'needs_review' else 'approve' end || ' — ' || codes, '') as reason from run_votes v left join c on v.case_id = c.case_id and v.role = c.role""",
            "run_votes",
            "run_findings",
        ),
    ),
    "l01_grade": (_grades, sql(f"with {_GRADE} select * from grades", "run_votes", "run_findings")),
    "l02_cohort": (
        lambda s, d: op.cohort(_grades(s, d), r.run_gold(s, d), r.run_cases(s, d)),
        sql(
            f"""with {_GRADE}, a as (select case_id, unnest(string_split(active, ',')) as code from grades where active <> ''),
            p as (select coalesce(a.code, b.code) as code, a.case_id is not null as raised, b.case_id is not null as gold from a full join run_gold b on a.case_id = b.case_id and a.code = b.code),
            n as (select code, count(*) filter (raised and gold) as tp, count(*) filter (raised and not gold) as fp, count(*) filter (not raised and gold) as fn from p group by grouping sets ((code), ()))
            select code, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) as precision, round(tp / nullif(tp + fn, 0), 3) as recall from n""",
            "run_votes",
            "run_findings",
            "run_gold",
        ),
    ),
}
