"""Queries of the rollups and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.hashing import split_of
from assaylake.operators import rollup as op
from assaylake.sources import relations as r
from assaylake.sources.relations import sql

_RUNS = """runs as (select case_id, run, any_value(gold_block) as gold_block,
  case when b >= w and b >= p then 'BLOCK' when w >= p then 'WARN' else 'PASS' end as verdict from (
    select case_id, run, any_value(gold_block) as gold_block, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p
    from votes group by case_id, run) group by case_id, run, b, w, p)"""
_MODAL = """modal as (select case_id, verdict as modal_verdict, c as modal_n from (
    select *, row_number() over (partition by case_id order by c desc, seen) as k from (
      select case_id, verdict, count(*) as c, min(run) as seen from runs group by case_id, verdict)) where k = 1)"""
_CASE = f"""{_RUNS}, {_MODAL}, per_case as (
  select case_id, any_value(gold_block) as gold_block, count(*) as n, count(*) filter (verdict = 'BLOCK') as n_block, count(*) filter (verdict = 'WARN') as n_warn,
    count(*) filter (verdict = 'PASS') as n_pass, any_value(modal_verdict) as modal_verdict, round(1 - any_value(modal_n) / count(*), 4) as instability,
    round(count(*) filter ((verdict = 'BLOCK') = gold_block) / count(*), 4) as match_rate
  from runs join modal using (case_id) group by case_id)"""

QUERIES = {
    "a01_case_rollup": (lambda s, d: op.case_rollup(r.votes(s, d)), sql(f"with {_CASE} select * from per_case", "votes")),
    "a03_pack_rollup": (
        lambda s, d: op.pack_rollup(r.votes(s, d)),
        sql(
            f"""with {_CASE} select count(*) as cases, round(avg(match_rate), 4) as mean_match_rate, round(avg(cast(instability > 0 as double)), 4) as instability_rate,
            round(count(*) filter (not gold_block and modal_verdict in ('BLOCK', 'WARN')) / nullif(count(*) filter (not gold_block), 0), 4) as false_block_rate from per_case""",
            "votes",
        ),
    ),
    "a16_intra_judge_stability": (
        lambda s, d: op.intra_judge_stability(r.votes(s, d)),
        sql(
            """select role, count(*) as cases, round(1 - avg(1 - m / n), 6) as stability from (
            select role, case_id, max(c) as m, sum(c) as n from (select role, case_id, vote, count(*) as c from votes group by all) group by all) where n >= 2 group by role""",
            "votes",
        ),
    ),
    "a38_split_counts": (
        lambda s, d: op.split_counts(r.cases(s, d).withColumn("split", split_of(F.col("case_id"))), "split", ["dev", "test", "train"]),
        sql(
            """select v.split, count(c.case_id) as n from (values ('dev'), ('test'), ('train')) v(split) left join (
            select case_id, case when cast('0x' || substr(sha1('split|' || case_id), 1, 8) as bigint) % 100 < 30 then 'test' else 'train' end as split from cases) c on v.split = c.split group by v.split""",
            "cases",
        ),
    ),
    "a39_code_usage": (lambda s, d: op.code_usage(r.findings(s, d)), sql("select code, count(*) as n from findings group by code", "findings")),
    "u05_pin_guard": (
        lambda s, d: op.pin_guard(r.run_log(s, d), ["agent", "signature"], "case_key"),
        sql("select case_key, count(distinct agent || '|' || signature) as pins, min(agent || '|' || signature) as first_pin, count(distinct agent || '|' || signature) > 1 as cross_pin from run_log group by case_key", "run_log"),
    ),
    "w16_majority_flags": (
        lambda s, d: op.majority_flags(r.findings(s, d), r.RUNS),
        sql("select case_id, code, count(distinct run) as k from findings group by case_id, code having count(distinct run) * 2 > 10", "findings"),
    ),
    "p09_sha_split": (
        lambda s, d: r.cases(s, d).select("case_id", split_of(F.col("case_id")).alias("split")),
        sql("select case_id, case when cast('0x' || substr(sha1('split|' || case_id), 1, 8) as bigint) % 100 < 30 then 'test' else 'train' end as split from cases", "cases"),
    ),
}
