"""Queries of agreement and calibration and their SQL twins."""

from __future__ import annotations

from assaylake.operators import agreement as ag
from assaylake.operators import calibration as ca
from assaylake.sources import relations as r
from assaylake.sources.relations import sql


def wilson_sql(a: str, n: str) -> str:
    """Interval columns of the SQL twins."""
    p, z = f"(cast({a} as double) / {n})", "1.96"
    mid, den = f"({p} + {z}*{z} / (2.0 * {n}))", f"(1 + {z}*{z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z}*{z} / (4.0 * {n} * {n})))"
    return f"case when {n} > 0 then round(greatest(0.0, ({mid} - {half}) / {den}), 6) end as ci_low, case when {n} > 0 then round(least(1.0, ({mid} + {half}) / {den}), 6) end as ci_high"


_KAPPA = """with c as (select role, case_id, vote, count(*) as c from votes group by all),
  i as (select role, case_id, sum(c) as n, sum(c * (c - 1)) as agree from c group by all),
  pe as (select role, sum(cast(c as double) * c) / (cast(sum(c) as double) * sum(c)) as pe from (select role, vote, sum(c) as c from c group by all) group by role),
  p as (select role, count(*) as items, cast(min(n) as bigint) as raters, avg(cast(agree as double) / (n * (n - 1))) as p from i group by role)"""
_GRADED = "g as (select *, (vote = 'BLOCK') = gold_block as ok from votes)"
_ECE = f"""{_GRADED}, bins as (select role, greatest(ceil(confidence * 10) - 1, 0) as bin, count(*) as n, avg(confidence) as conf, avg(cast(ok as double)) as acc from g where confidence is not null group by 1, 2),
  e as (select role, cast(sum(n) as bigint) as n, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from bins group by role)"""
_PHI = """with e as (select case_id, run, role, (vote = 'BLOCK') <> gold_block as err from votes),
  n as (select a.role as role_a, b.role as role_b, count(*) filter (a.err and b.err) as n11, count(*) filter (a.err and not b.err) as n10, count(*) filter (not a.err and b.err) as n01, count(*) filter (not a.err and not b.err) as n00
    from e a join e b on a.case_id = b.case_id and a.run = b.run and a.role < b.role group by all),
  phi as (select *, case when cast(n11+n10 as double)*(n01+n00)*(n11+n01)*(n10+n00) > 0 then
    round((cast(n11 as double)*n00 - cast(n10 as double)*n01) / sqrt(cast(n11+n10 as double)*(n01+n00)*(n11+n01)*(n10+n00)), 6) end as phi from n)"""
_SCORE = "case vote when 'BLOCK' then 0.0::double when 'WARN' then 0.5::double else 1.0::double end"

QUERIES = {
    "a05_fleiss": (
        lambda s, d: ag.fleiss_kappa(r.votes(s, d), ["case_id"], "vote", ["role"], guarded=False),
        sql(f"{_KAPPA} select role, items, raters, case when pe >= 1 then 1.0 else round((p - pe) / (1 - pe), 6) end as kappa, false as insufficient from p join pe using (role)", "votes"),
    ),
    "a06_fleiss_guarded": (
        lambda s, d: ag.fleiss_kappa(r.votes(s, d), ["case_id", "run"], "vote"),
        sql(
            """with c as (select case_id, run, vote, count(*) as c from votes group by all), i as (select case_id, run, sum(c) as n, sum(c * (c - 1)) as agree from c group by all),
            pe as (select sum(cast(c as double) * c) / (cast(sum(c) as double) * sum(c)) as pe from (select vote, sum(c) as c from c group by all))
            select count(*) as items, cast(min(n) as bigint) as raters, round((avg(cast(agree as double) / (n * (n - 1))) - any_value(pe)) / (1 - any_value(pe)), 6) as kappa, false as insufficient from i, pe""",
            "votes",
        ),
    ),
    "a07_cohen": (
        lambda s, d: ag.cohen_kappa(r.votes(s, d).selectExpr("role", "vote = 'BLOCK' as pred", "gold_block"), "pred", "gold_block", ["role"]),
        sql(
            """with n as (select role, count(*) as n, count(*) filter ((vote = 'BLOCK') = gold_block) as same, count(*) filter (vote = 'BLOCK') as p1, count(*) filter (gold_block) as g1 from votes group by role),
            e as (select *, (p1 * g1 + (n - p1) * (n - g1)) / (cast(n as double) * n) as pe, same / cast(n as double) as po from n)
            select role, n, case when pe < 1 then round((po - pe) / (1 - pe), 6) end as kappa, pe >= 1 as insufficient from e""",
            "votes",
        ),
    ),
    "a13_error_phi": (lambda s, d: ag.pairwise_phi(r.votes(s, d)), sql(f"{_PHI} select * from phi", "votes")),
    "a14_effective_votes": (
        lambda s, d: ag.effective_votes(r.votes(s, d)),
        sql(
            f"""{_PHI} select (select count(distinct role) from votes) as k, count(phi) as pairs, round(avg(phi), 6) as mean_phi,
            round((select count(distinct role) from votes) / (1 + ((select count(distinct role) from votes) - 1) * round(avg(phi), 6)), 6) as n_eff from phi""",
            "votes",
        ),
    ),
    "a31_arm_agreement": (
        lambda s, d: ag.arm_agreement(r.votes(s, d), 0, 1),
        sql(
            """select a.role, count(*) as n, round(100 * avg(cast(a.vote = b.vote as double)), 2) as agreement_percent, round(avg(b.confidence - a.confidence), 6) as mean_confidence_delta,
            count(b.confidence - a.confidence) as n_paired from votes a join votes b on a.case_id = b.case_id and a.role = b.role and a.run = 0 and b.run = 1 group by a.role""",
            "votes",
        ),
    ),
    "a08_wilson": (
        lambda s, d: ca.accuracy(r.votes(s, d)),
        sql(f"with {_GRADED}, n as (select role, count(*) filter (ok) as successes, count(*) as trials from g group by role) select *, round(successes / trials, 6) as value, {wilson_sql('successes', 'trials')} from n", "votes"),
    ),
    "a09_ece_right": (lambda s, d: ca.ece_right_closed(r.votes(s, d)), sql(f"with {_ECE} select * from e", "votes")),
    "a10_reliability_bins": (
        lambda s, d: ca.reliability_bins(r.votes(s, d)),
        sql(
            f"""with {_GRADED} select role, cast(least(floor(confidence * 10), 9) as integer) as bin, count(*) as n, round(avg(confidence), 6) as mean_confidence,
            round(avg(cast(ok as double)), 6) as accuracy, count(*) < 5 as caveat from g where confidence is not null group by 1, 2""",
            "votes",
        ),
    ),
    "a11_pooled_check": (
        lambda s, d: ca.pooled_check(r.votes(s, d)),
        sql(
            f"""with {_ECE} select (select round(avg(cast(ok as double)), 6) from g) as match_rate, cast(sum(n) as bigint) as n, round(sum(n * ece) / sum(n), 6) as pooled_ece,
            case when sum(n * ece) / sum(n) > 0.15 then 'WARN' else 'PASS' end as advice from e""",
            "votes",
        ),
    ),
    "a12_brier": (lambda s, d: ca.brier(r.votes(s, d)), sql(f"with {_GRADED} select role, count(*) as n, round(avg((confidence - cast(ok as double)) * (confidence - cast(ok as double))), 6) as brier from g where confidence is not null group by role", "votes")),
    "a15_selective": (
        lambda s, d: ca.selective(r.votes(s, d)),
        sql(
            f"""with {_GRADED}, n as (select role, count(*) as n, count(*) filter (vote <> 'WARN') as decided, count(*) filter (vote <> 'WARN' and ok) as right_n from g group by role)
            select role, n, decided, round(decided / n, 6) as coverage, round(right_n / decided, 6) as accuracy, {wilson_sql('right_n', 'decided')}, round(1 - right_n / decided, 6) as risk from n""",
            "votes",
        ),
    ),
    "a29_sampling_reduction": (
        lambda s, d: ca.sampling_reduction(r.votes(s, d)),
        sql(
            f"""with q as (select case_id, role, vote, count(*) as c, min(run) as seen from votes group by case_id, role, vote),
            m as (select *, row_number() over (partition by case_id, role order by c desc, seen) as k, sum(c) over (partition by case_id, role) as n from q)
            select v.case_id, v.role, round(avg({_SCORE.replace('vote', 'v.vote')}), 6) as score_mean, round(var_pop({_SCORE.replace('vote', 'v.vote')}), 6) as variance, any_value(m.vote) as decision, cast(any_value(m.n) as bigint) as n
            from votes v join m on v.case_id = m.case_id and v.role = m.role and m.k = 1 group by v.case_id, v.role""",
            "votes",
        ),
    ),
    "a30_k_majority": (
        lambda s, d: ca.k_majority(r.votes(s, d)),
        sql(
            """select case_id, role, count(*) as k, case when count(*) filter (vote = 'BLOCK') > count(*) // 2 then false when count(*) filter (vote = 'PASS') > count(*) // 2 then true end as conforms
            from votes group by case_id, role""",
            "votes",
        ),
    ),
    "a33_risk_determinations": (
        lambda s, d: ca.risk_determinations(r.votes(s, d)),
        sql(
            """select role, run, case vote when 'BLOCK' then 'high' when 'WARN' then 'medium' else 'none' end as category, count(*) as n, round(avg(confidence) filter (confidence <> 0), 3) as confidence,
            case vote when 'BLOCK' then 0 when 'WARN' then 1 else 2 end as severity_rank from votes group by role, run, vote""",
            "votes",
        ),
    ),
    "w10_k_sweep": (
        lambda s, d: ca.prefix_sweep(r.votes(s, d), "risk", r.RUNS),
        sql(
            f"""with s as (select case_id, list({_SCORE} order by run) as s from votes where role = 'risk' group by case_id),
            h as (select k.k, s.s, s.s[1:k.k] as head from s, (select cast(unnest(range(1, 11)) as integer) as k) k where len(s.s) >= k.k),
            m as (select k, head, sign(len(list_filter(head, lambda x: x > 0.5)) - len(list_filter(head, lambda x: x < 0.5))) as a, sign(len(list_filter(s, lambda x: x > 0.5)) - len(list_filter(s, lambda x: x < 0.5))) as b from h),
            n as (select k, count(*) as cases, count(*) filter (a <> b) as flips, count(*) filter (a = b and b <> 0) as converged, round(avg(list_var_pop(head)), 6) as mean_variance from m group by k)
            select k, cases, flips, round(flips / cases, 6) as flip_rate, {wilson_sql('flips', 'cases')}, converged, round(converged / cases, 6) as convergence,
            {wilson_sql('converged', 'cases').replace('ci_low', 'convergence_low').replace('ci_high', 'convergence_high')}, mean_variance from n""",
            "votes",
        ),
    ),
}
