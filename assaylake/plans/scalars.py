"""Queries of scalar functions, unions, top-k reads and record joins, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import text as t
from assaylake.functions.hashing import content_id, seed31
from assaylake.operators import records
from assaylake.plans.text import _stem
from assaylake.sources import relations as r
from assaylake.sources.relations import sql


def _docs(s, d):
    return r.table(s, d, "documents").select("doc_id", "text")


def stems(s, d):
    words = F.explode(t.source_stems(F.col("text"))).alias("stem")
    return _docs(s, d).select("doc_id", words).filter(F.col("stem") != "").groupBy("stem").agg(F.count(F.lit(1)).alias("docs"))


def salient(s, d):
    x = t.salient_stems(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(x), " ")).alias("digest"))


def truncated(s, d):
    x = t.head_and_tail(F.col("text"))
    return _docs(s, d).select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x).alias("digest"))


def slugs(s, d):
    return _docs(s, d).select("doc_id", t.slug(F.col("text")).alias("slug"))


def seeds(s, d):
    return r.run_votes(s, d).select("case_id", "role", seed31(F.col("case_id"), F.col("role")).alias("seed"), content_id("run-", F.col("case_id"), F.col("role")).alias("run_id"))


def lines(s, d):
    return _docs(s, d).select("doc_id", t.line_with(F.col("text"), F.lit("license")).alias("line"))


def merged_flags(s, d):
    """Codes of a case over its stages (judges), one sorted list, with the stages that raised any."""
    f = r.run_findings(s, d)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return f.groupBy("case_id").agg(join("code").alias("codes"), join("role").alias("stages"))


def stage_union(s, d):
    """Findings of three stages as one bag with the stage's ordinal."""
    f = r.run_findings(s, d).select("case_id", "role", "code")
    parts = [f.filter(F.col("role") == x).select("case_id", "code", F.lit(i).alias("stage")) for i, x in enumerate(("policy", "risk", "faithfulness"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"))


def corroborated(s, d):
    """Findings outside a judge's lens whose code another judge raised within its own."""
    from assaylake.plans.scorecard import _lens

    f, lens = r.run_findings(s, d).select("case_id", "role", "code"), _lens(s)
    inside = f.join(lens, ["role", "code"], "left_semi").select("case_id", "code").distinct()
    return f.join(lens, ["role", "code"], "left_anti").join(inside, ["case_id", "code"], "left_semi")


def first_seen(s, d):
    """Of each agent the verdict of its first run, and of its first blocking run."""
    log = r.run_log(s, d)
    return log.groupBy("agent").agg(F.min_by("verdict", "seq").alias("first_verdict"), F.min(F.when(F.col("verdict") == "BLOCK", F.col("seq"))).alias("first_block"))


def browser(s, d):
    """Cases of two sources, the labeled first, each once, the first 500 by id with whether more are left."""
    c = r.cases(s, d)
    rows = c.filter("labeled").select("case_id", F.lit(0).alias("priority")).unionByName(c.select("case_id", F.lit(1).alias("priority")))
    one = rows.groupBy("case_id").agg(F.min("priority").alias("priority"))
    return one.orderBy("priority", "case_id").limit(500).crossJoin(one.agg((F.count(F.lit(1)) > 500).alias("truncated")))


def unmatched(s, d):
    """Verdicts joined to their cases: those without a case are counted apart."""
    v = r.run_log(s, d).select("case_key", "verdict")
    c = r.table(s, d, "customer").select((F.col("c_custkey") * 2).alias("case_key"), F.lit(True).alias("known"))
    return v.join(c, "case_key", "left").groupBy("verdict").agg(F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("unmatched"))


def case_browser(s, d):
    """Cases with their number of runs and their authoritative head."""
    from assaylake.operators.history import latest_authoritative

    log = r.run_log(s, d)
    n = log.groupBy("case_key").agg(F.count(F.lit(1)).alias("runs"))
    return n.join(latest_authoritative(log, ["case_key"], "seq", ["verdict"]), "case_key", "left")


def severities(s, d):
    word = F.element_at(F.array(*[F.lit(x) for x in ("High", "critical", "low", "odd", " minor ")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(s, d).select(records.normalized_severity(word).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: {}))".format(_stem("w"))
_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
_SALIENT = f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: regexp_matches(w, '^[0-9]+$') or (length(w) >= 4 and w not in ({_STOP}))), lambda w: {_stem('w')}))"
_CUT = "case when length(text) > 2000 then substr(text, 1, 800) || chr(10) || '...[truncated]...' || chr(10) || right(text, 800) else text end"
_LENS = "lens as (select role, code from dim_role, dim_code where owner = '' or owner = role)"

QUERIES = {
    "f04_stems": (stems, f"select stem, count(*) as docs from (select doc_id, unnest({_WORDS}) as stem from documents) where stem <> '' group by stem"),
    "f05_salient": (salient, f"with k as (select doc_id, {_SALIENT} as x from documents) select doc_id, len(x) as n, md5(array_to_string(list_sort(x), ' ')) as digest from k"),
    "f20_head_and_tail": (truncated, f"select doc_id, length({_CUT}) as n, md5({_CUT}) as digest from documents"),
    "f16_slug": (slugs, "select doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents"),
    "f16_title_slug": (
        lambda s, d: _docs(s, d).select("doc_id", t.title_slug(F.col("text")).alias("slug")),
        "select doc_id, regexp_replace(regexp_replace(upper(replace(trim(text), 'ß', 'ss')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents",
    ),
    "f32_seeds": (
        seeds,
        sql("select case_id, role, cast('0x' || substr(sha256(case_id || '|' || role), 1, 8) as bigint) % 2147483648 as seed, 'run-' || substr(sha1(case_id || '|' || role), 1, 12) as run_id from run_votes", "run_votes"),
    ),
    "f07_line_with": (lines, "select doc_id, trim(list_extract(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license')), 1)) as line from documents"),
    "u02_merged_flags": (merged_flags, sql("select case_id, string_agg(distinct code, ',' order by code) as codes, string_agg(distinct role, ',' order by role) as stages from run_findings group by case_id", "run_findings")),
    "u01_stage_union": (stage_union, sql("select case role when 'policy' then 0 when 'risk' then 1 else 2 end as stage, code, count(*) as n from run_findings group by all", "run_findings")),
    "j11_corroborated": (
        corroborated,
        sql(f"with {_LENS}, f as (select case_id, role, code from run_findings), i as (select distinct case_id, code from f join lens using (role, code)) select case_id, role, code from f anti join lens using (role, code) where (case_id, code) in (select (case_id, code) from i)", "run_findings"),
    ),
    "w12_first_seen": (first_seen, sql("select agent, arg_min(verdict, seq) as first_verdict, min(seq) filter (verdict = 'BLOCK') as first_block from run_log group by agent", "run_log")),
    "w14_case_browser": (
        browser,
        sql("with o as (select case_id, case when labeled then 0 else 1 end as priority from cases) select *, (select count(*) > 500 from o) as truncated from (select * from o order by priority, case_id limit 500)", "cases"),
    ),
    "j03_unmatched": (unmatched, sql("select verdict, count(*) filter (c_custkey is not null) as matched, count(*) filter (c_custkey is null) as unmatched from run_log left join customer on case_key = c_custkey * 2 group by verdict", "run_log")),
    "j14_case_heads": (
        case_browser,
        sql("select case_key, count(*) as runs, arg_max(verdict, seq) filter (replay_of is null) as verdict, max(seq) filter (replay_of is null) as seq from run_log group by case_key", "run_log"),
    ),
    "p24_severities": (severities, "select case doc_id % 5 when 0 then 'HIGH' when 1 then 'HIGH' when 2 then 'LOW' when 3 then 'MEDIUM' else 'LOW' end as severity, count(*) as n from documents group by 1"),
}
