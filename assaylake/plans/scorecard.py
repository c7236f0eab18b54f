"""Queries of the scorecards and their SQL twins."""

from __future__ import annotations

from assaylake.operators import rollup
from assaylake.operators import scorecard as op
from assaylake.sources import relations as r
from assaylake.sources.relations import sql

_PAIRS = """pairs as (select coalesce(a.case_id, b.case_id) as case_id, coalesce(a.code, b.code) as code, a.case_id is not null as raised, b.case_id is not null as gold
  from (select distinct case_id, code from run_findings) a full join run_gold b on a.case_id = b.case_id and a.code = b.code)"""
_TPFPFN = "count(*) filter (raised and gold) as tp, count(*) filter (raised and not gold) as fp, count(*) filter (not raised and gold) as fn"
_PR = "round(tp / nullif(tp + fp, 0), 3) as precision, round(tp / nullif(tp + fn, 0), 3) as recall"
_OUTCOME = """runs as (select case_id, any_value(gold_block) as gold_block, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p from run_votes group by case_id),
  outcomes as (select case_id, ((b >= w and b >= p) = gold_block) as match from runs)"""


def _pairs(s, d):
    return op.raised_and_gold(r.run_findings(s, d), r.run_gold(s, d), r.run_cases(s, d))


def _lens(s):
    """A judge sees the codes that it owns and those without an owner."""
    codes = r.dim_code(s)
    return r.dim_role(s).select("role").crossJoin(codes.select("code", "owner")).filter("owner = '' or owner = role").select("role", "code")


def _outcomes(s, d):
    return rollup.compose_runs(r.run_votes(s, d)).selectExpr("case_id", "(verdict = 'BLOCK') = gold_block as match")


QUERIES = {
    "a18_flag_scorecard": (
        lambda s, d: op.flag_scorecard(_pairs(s, d)),
        sql(f"with {_PAIRS}, n as (select code, {_TPFPFN} from pairs group by grouping sets ((code), ())) select code, tp, fp, fn, {_PR} from n", "run_findings", "run_gold"),
    ),
    "a18_by_judge": (
        lambda s, d: op.judge_scorecard(r.run_findings(s, d), r.run_gold(s, d)),
        sql(
            f"""with a as (select distinct role, case_id, code from run_findings), b as (select role, case_id, code from (select distinct role from a), run_gold),
            p as (select coalesce(a.role, b.role) as role, a.role is not null as raised, b.role is not null as gold from a full join b on a.role = b.role and a.case_id = b.case_id and a.code = b.code),
            n as (select role, {_TPFPFN} from p group by role) select role, tp, fp, fn, {_PR} from n""",
            "run_findings",
            "run_gold",
        ),
    ),
    "a18_majority": (
        lambda s, d: op.majority_scorecard(r.run_votes(s, d)),
        sql(
            """with n as (select case_id, any_value(gold_block) as gold, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'PASS') as p from run_votes group by case_id)
            select case when b > p then 'BLOCK' when p > b then 'PASS' else 'TIE' end as majority, count(*) as cases, count(*) filter (gold) as gold_block, count(*) filter (not gold) as gold_clean from n group by 1""",
            "run_votes",
        ),
    ),
    "a19_lens_confusion": (
        lambda s, d: op.lens_confusion(r.run_findings(s, d), r.run_gold(s, d), _lens(s), r.run_cases(s, d)),
        sql(
            f"""with lens as (select role, code from dim_role, dim_code where owner = '' or owner = role), f as (select distinct role, case_id, code from run_findings),
            a as (select f.* from f join lens using (role, code)), o as (select role, count(*) as out_of_lens from f anti join lens using (role, code) group by role), b as (select role, case_id, code from run_gold join lens using (code)),
            p as (select coalesce(a.role, b.role) as role, a.role is not null as raised, b.role is not null as gold from a full join b on a.role = b.role and a.case_id = b.case_id and a.code = b.code)
            select p.role, {_TPFPFN}, coalesce(any_value(out_of_lens), 0) as out_of_lens from p left join o on p.role = o.role group by p.role""",
            "run_findings",
            "run_gold",
        ),
    ),
    "a20_partial_credit": (
        lambda s, d: op.partial_credit(_pairs(s, d)),
        sql(f"with {_PAIRS}, n as (select case_id, {_TPFPFN} from pairs group by case_id) select *, case when fp + fn = 0 then 1.0 else round(2 * tp / (2 * tp + fp + fn), 6) end as credit from n", "run_findings", "run_gold"),
    ),
    "u03_caught_missed_spurious": (
        lambda s, d: op.caught_missed_spurious(_pairs(s, d)),
        sql(
            f"""with {_PAIRS} select case_id, coalesce(string_agg(code, ',' order by code) filter (raised and gold), '') as caught, coalesce(string_agg(code, ',' order by code) filter (not raised and gold), '') as missed,
            coalesce(string_agg(code, ',' order by code) filter (raised and not gold), '') as spurious from pairs group by case_id""",
            "run_findings",
            "run_gold",
        ),
    ),
    "a23_release_gate": (
        lambda s, d: op.release_gate(_outcomes(s, d), _pairs(s, d), r.dim_code(s)),
        sql(
            f"""with {_PAIRS}, {_OUTCOME}, n as (select count(distinct case_id) as never_events from pairs join dim_code using (code) where raised <> gold and tier = 1),
            o as (select round(100 * avg(cast(match as double)), 4) as reliability, count(*) as cases from outcomes)
            select reliability, cases, never_events, reliability >= 96.0 and never_events = 0 as released from o, n""",
            "run_votes",
            "run_findings",
            "run_gold",
        ),
    ),
    "p05_gold_predicates": (
        lambda s, d: op.gold_predicates(r.cases(s, d), r.gold_codes(s, d)),
        sql(
            """select c.case_id, count(g.code) as n_codes, any_value(labeled) as labeled, coalesce(any_value(gold_block), false) or count(g.code) > 0 as has_gold
            from cases c left join gold_codes g on c.case_id = g.case_id group by c.case_id""",
            "cases",
            "gold_codes",
        ),
    ),
    "p06_descoped_gold": (
        lambda s, d: op.descoped_gold(r.gold_codes(s, d), r.dim_code(s)),
        sql("select case_id, count(*) as n_gold, count(*) filter (gradeable) as n_gradeable, count(*) filter (gradeable) = 0 as dropped from gold_codes join dim_code using (code) group by case_id", "gold_codes"),
    ),
    "p15_outside_snapshot": (
        lambda s, d: op.outside_snapshot(r.findings(s, d), r.dim_code(s).filter("gradeable").select("code")),
        sql("select code, count(*) as n from findings where not gradeable group by code", "run_findings"),
    ),
    "j18_label_owners": (
        lambda s, d: op.label_owners(r.cases(s, d), r.gold_codes(s, d), r.dim_code(s)),
        sql("select c.code, any_value(c.tier) as tier, any_value(c.owner) as owner, count(distinct g.case_id) as cases from dim_code c left join gold_codes g on c.code = g.code group by c.code", "gold_codes"),
    ),
    "a40_floor_flips": (
        lambda s, d: op.floor_flips(r.run_log(s, d)),
        sql(
            """with l as (select agent, verdict, row_number() over w as k, lead(verdict) over w as before from run_log where replay_of is null window w as (partition by agent, case_key order by ts desc, seq desc))
            select agent, count(*) as cases, count(*) filter (before = 'BLOCK' and verdict = 'PASS') as flips from l where k = 1 group by agent""",
            "run_log",
        ),
    ),
}
