"""Queries of contracts, metrics and backends, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import plugins
from assaylake.plans.text import _plain
from assaylake.sources import relations as r
from assaylake.sources.relations import sql

DECLARED = [("contradiction", "presence", {"least": 5}), ("contradiction", "quoted", {}), ("fabrication", "quoted", {}), ("omission", "presence", {"least": 4}), ("omission", "quoted", {"least": 6})]


def _findings(s, d):
    """Findings of the labeled cases with a subject and a quote that follow the code, against the whole text."""
    f = r.findings(s, d).select("case_id", "code").distinct()
    docs = r.table(s, d, "documents").select(F.col("doc_id").alias("case_id"), "text")
    odd = F.length("code") % 2 == 0
    subject = F.when(F.col("case_id") % 3 == 0, "of at in").when(odd, F.concat(F.lit("zzyzx "), F.split_part("text", F.lit(" "), F.lit(3)))).otherwise("nowhereatall")
    quote = F.when(F.col("case_id") % 2 == 0, F.substring("text", 5, 30)).otherwise("this was never said by anyone")
    return f.join(docs, "case_id").select("case_id", "code", subject.alias("subject"), quote.alias("quote"), "text")


def chain(s, d):
    return plugins.disproved(_findings(s, d), DECLARED)


def _judged(s, d):
    """Each judge's raised codes of a case in its first run against the gold codes."""
    raised = r.findings(s, d, run=0).groupBy("case_id", "role").agg(F.collect_set("code").alias("raised"))
    gold = r.gold_codes(s, d).groupBy("case_id").agg(F.collect_set("code").alias("expected"))
    return r.votes(s, d).filter("run = 0").select("case_id", "role").join(gold, "case_id", "left").join(raised, ["case_id", "role"], "left")


LENS = ("contradiction", "fabrication", "unsafe_advice")


def metric(aware):
    return lambda s, d: plugins.JudgeMetric(LENS, aware).over(_judged(s, d), ["role"])


class Rules(plugins.Backend):
    """Blocks texts with a number of five digits, asks for review of short ones, and fails on empty ones."""

    pin = plugins.Pin("rules", "2")

    def evaluate(self, case: dict) -> plugins.Verdict:
        import re

        text = case["text"]
        if not text:
            raise ValueError("no text")
        long = re.search("[0-9]{5}", text, re.ASCII)
        return plugins.Verdict("BLOCK" if long else "PASS", "WARN" if len(text) < 200 else "PASS", ["number"] if long else [])


def backend(s, d):
    docs = r.table(s, d, "documents").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 50 > 0, F.col("text")).alias("text"))
    return plugins.evaluated(docs, Rules).select("case_id", "compliance", "artifact", F.array_join("flags", ",").alias("flags"), "error", "backend", "version")


def _scores(aware: bool) -> str:
    lens = ", ".join(f"'{c}'" for c in LENS)
    neutral = "count(*) filter (raised and expected and not own)" if aware else "0"
    wrong = "count(*) filter (raised and not (own and expected)" + (" and not (expected and not own))" if aware else ")")
    return f"""with v as (select case_id, role from votes where run = 0), k as (select v.case_id, v.role, c.code, c.code in ({lens}) as own, g.code is not null as expected, f.code is not null as raised from v cross join dim_code c
        left join gold_codes g on v.case_id = g.case_id and c.code = g.code left join (select distinct case_id, role, code from findings where run = 0) f on v.case_id = f.case_id and v.role = f.role and c.code = f.code),
      n as (select case_id, role, count(*) filter (raised and own and expected) as tp, {wrong} as fp, count(*) filter (own and expected and not raised) as fn, {neutral} as neutral from k group by case_id, role),
      m as (select *, case when fp = 0 and fn = 0 then 1.0 else 2 * tp / nullif(2 * tp + fp + fn, 0) end as graded from n)
      select role, sum(fp) = 0 and sum(fn) = 0 as accepted, round(avg(graded), 6) as graded, round(case when sum(tp) + sum(fp) > 0 then sum(tp) / (sum(tp) + sum(fp)) else 1.0 end, 4) as precision,
        round(case when sum(tp) + sum(fn) > 0 then sum(tp) / (sum(tp) + sum(fn)) else 1.0 end, 4) as recall, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(neutral) as bigint) as neutral, count(*) as n from m group by role"""


def _held(least: int) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(subject), '[^a-z]+'), lambda w: length(w) >= {least} and contains(lower(text), w))) > 0"


def _said(least: int) -> str:
    return f"length({_plain('quote')}) >= {least} and contains({_plain('text')}, {_plain('quote')})"


QUERIES = {
    "x11_disproved": (
        chain,
        sql(
            f"""with f as (select distinct case_id, code from findings), k as (select f.*, text, case when case_id % 3 = 0 then 'of at in' when length(code) % 2 = 0 then 'zzyzx ' || split_part(text, ' ', 3) else 'nowhereatall' end as subject,
                case when case_id % 2 = 0 then substr(text, 5, 30) else 'this was never said by anyone' end as quote from f join documents on case_id = doc_id)
              select case_id, code, case code when 'contradiction' then case when {_held(5)} then 'presence' when {_said(12)} then 'quoted' end when 'fabrication' then case when {_said(12)} then 'quoted' end
                when 'omission' then case when {_held(4)} then 'presence' when {_said(6)} then 'quoted' end end as contract from k""",
            "findings",
        ),
    ),
    "x11_judge_metric": (metric(False), sql(_scores(False), "findings", "gold_codes")),
    "x11_judge_metric_aware": (metric(True), sql(_scores(True), "findings", "gold_codes")),
    "x11_backend": (
        backend,
        """with k as (select doc_id, case when doc_id % 50 > 0 then text end as x from documents), m as (select *, coalesce(x, '') = '' as empty, regexp_matches(x, '[0-9]{5}') as long from k)
            select doc_id as case_id, case when empty then 'NEUTRAL' when long then 'BLOCK' else 'PASS' end as compliance, case when empty then 'NEUTRAL' when length(x) < 200 then 'WARN' else 'PASS' end as artifact,
            case when not empty and long then 'number' else '' end as flags, case when empty then 'ValueError: no text' end as error, 'rules' as backend, '2' as version from m""",
    ),
}
