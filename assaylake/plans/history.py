"""Queries of run history and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import history as op
from assaylake.operators import prefix
from assaylake.sources import relations as r
from assaylake.sources.relations import sql


def _baseline(s, d):
    o = r.table(s, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "P", "WARN").otherwise("PASS").alias("verdict"))
    half = lambda p: o.filter(F.col("k") % 2 == p).groupBy("case_id").agg(F.max_by("verdict", "k").alias("verdict"))
    return half(0), half(1)


_ORDERS = """o as (select o_custkey as case_id, o_orderkey as k, case o_orderstatus when 'F' then 'BLOCK' when 'P' then 'WARN' else 'PASS' end as verdict from orders),
  a as (select case_id, arg_max(verdict, k) as v from o where k % 2 = 0 group by case_id), b as (select case_id, arg_max(verdict, k) as v from o where k % 2 = 1 group by case_id)"""

QUERIES = {
    "w01_latest_head": (lambda s, d: op.latest(r.run_log(s, d), ["agent", "case_key"], "seq", ["verdict", "signature"]), sql("select agent, case_key, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature, max(seq) as seq from run_log group by agent, case_key", "run_log")),
    "w02_authoritative": (
        lambda s, d: op.latest_authoritative(r.run_log(s, d), ["agent", "case_key"], "seq", ["verdict", "signature"]),
        sql("select agent, case_key, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature, max(seq) as seq from run_log where replay_of is null group by agent, case_key", "run_log"),
    ),
    "w04_versions": (
        lambda s, d: prefix.versions(r.run_log(s, d).select("agent", "case_key", "seq", "verdict"), ["agent", "case_key"], "seq").selectExpr("agent", "case_key", "seq", "verdict", "cast(version as bigint) as version", "state"),
        sql(
            """select agent, case_key, seq, verdict, row_number() over w as version, case when row_number() over w = count(*) over (partition by agent, case_key) then 'current' else 'superseded' end as state
            from run_log window w as (partition by agent, case_key order by seq)""",
            "run_log",
        ),
    ),
    "w06_history_sequence": (
        lambda s, d: prefix.first_created(r.run_log(s, d).select("case_key", "seq", "ts"), ["case_key"], "seq").selectExpr("case_key", "seq", "cast(history_seq as bigint) as history_seq", "date_format(created_at, 'yyyy-MM-dd HH:mm:ss') as created_at"),
        sql("select case_key, seq, row_number() over w as history_seq, strftime(first_value(ts) over w, '%Y-%m-%d %H:%M:%S') as created_at from run_log window w as (partition by case_key order by seq)", "run_log"),
    ),
    "w08_signature_segments": (
        lambda s, d: prefix.segments(r.run_log(s, d), "case_key", "signature", ["seq"]).selectExpr("case_key", "segment", "signature", "start", "`end`", "n"),
        sql(
            """with c as (select case_key, seq, signature, case when signature is not distinct from lag(signature) over w and row_number() over w > 1 then 0 else 1 end as change from run_log window w as (partition by case_key order by seq)),
            g as (select *, cast(sum(change) over (partition by case_key order by seq rows unbounded preceding) as bigint) as segment from c)
            select case_key, segment, signature, min(seq) as start, max(seq) as "end", count(*) as n from g group by case_key, segment, signature""",
            "run_log",
        ),
    ),
    "w09_tail": (
        lambda s, d: op.tail(r.run_log(s, d).select("case_key", "seq", "verdict"), "case_key", ["seq"], 20).selectExpr("case_key", "seq", "verdict", "cast(place as bigint) as place"),
        sql(
            """with k as (select *, row_number() over (partition by case_key order by seq desc) as k from run_log)
            select case_key, seq, verdict, row_number() over (partition by case_key order by seq) as place from k where k <= 20""",
            "run_log",
        ),
    ),
    "w11_every_nth": (
        lambda s, d: op.every_nth(r.cases(s, d).select("case_id", "source"), 3, "case_id", "source"),
        sql("select case_id, source, case when (row_number() over (partition by source order by case_id) - 1) % 3 = 2 then 'test' else 'train' end as split from cases", "cases"),
    ),
    "l06_audit_query": (
        lambda s, d: op.audit(r.run_log(s, d), actor="click", since="2024-01-10 00:00:00").select("seq", "case_key", "verdict"),
        sql("select seq, case_key, verdict from run_log where agent = 'click' and ts >= timestamp '2024-01-10 00:00:00'", "run_log"),
    ),
    "w18_latency_percentiles": (
        lambda s, d: op.latency_percentiles(r.run_log(s, d), "agent", "value"),
        sql("select agent, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from run_log group by agent", "run_log"),
    ),
    "j04_canary_diff": (
        lambda s, d: op.diff_verdicts(*_baseline(s, d), "case_id"),
        sql(f"with {_ORDERS} select coalesce(a.case_id, b.case_id) as case_id, coalesce(a.v, 'ABSENT') as baseline, coalesce(b.v, 'ABSENT') as current from a full join b on a.case_id = b.case_id where coalesce(a.v, 'ABSENT') <> coalesce(b.v, 'ABSENT')"),
    ),
    "u04_flag_delta": (
        lambda s, d: op.flag_delta(r.findings(s, d, 0), r.findings(s, d, 1)),
        sql(
            """with a as (select distinct case_id, code from findings where run = 0), b as (select distinct case_id, code from findings where run = 1),
            m as (select coalesce(a.case_id, b.case_id) as case_id, case when b.code is not null then '+' || b.code else '-' || a.code end as mark from a full join b on a.case_id = b.case_id and a.code = b.code where a.code is null or b.code is null)
            select case_id, string_agg(mark, ' ' order by mark) as delta from m group by case_id""",
            "findings",
        ),
    ),
    "j20_store_precedence": (
        lambda s, d: op.union_history([(i, r.run_log(s, d).filter(f"agent = '{a}'").groupBy("case_key").agg(F.max_by("verdict", "seq").alias("verdict"))) for i, a in enumerate(("purchase", "click", "view"))], "case_key"),
        sql(
            """with s as (select case_key, case agent when 'purchase' then 0 when 'click' then 1 else 2 end as priority, arg_max(verdict, seq) as verdict from run_log where agent in ('purchase', 'click', 'view') group by all)
            select case_key, arg_min(verdict, priority) as verdict, cast(min(priority) as integer) as priority from s group by case_key""",
            "run_log",
        ),
    ),
}
