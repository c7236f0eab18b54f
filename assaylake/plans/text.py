"""Queries of grounding, units, conversation measures and case generation, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import text as t
from assaylake.functions.hashing import uniform
from assaylake.operators import containment, datagen, grounding, hierarchy, kpi, neighbours, units
from assaylake.sources import relations as r
from assaylake.sources.relations import _u, sql

VALUE = "[0-9]+"


def _spans(s, d):
    """All documents and all passages, which the operators join by what they share."""
    return r.table(s, d, "documents").select("doc_id", "text"), r.table(s, d, "benchmark").select("item_id", "text")


def _claims(of_source: str, of_quote: str) -> str:
    """case_id, item_id, s and q: every text against every passage, both cut into tokens once."""
    return f"d as materialized (select doc_id as case_id, {of_source} as s from documents), b as materialized (select item_id, {of_quote} as q from benchmark), k as (select * from d, b)"


_EV = t.EVIDENCE_SPLIT.replace("'", "''")


def _tokens(x: str, pattern: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{pattern}'), lambda w: w <> ''))"


def _common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _stem(x: str) -> str:
    return f"""case when length({x}) >= 6 and {x}[-3:] = 'ing' then {x}[:-4] when length({x}) >= 5 and {x}[-2:] = 'ed' then {x}[:-3]
      when length({x}) >= 4 and {x}[-1:] = 's' and {x}[-2:] <> 'ss' then {x}[:-2] else {x} end"""


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _runs(w: str) -> str:
    """Runs of words in a list of them."""
    n = containment.RUN
    return f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))"


def _redacted(x: str) -> str:
    for kind, pattern in t.REDACTIONS.items():
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED_{kind.upper()}]', 'g')"
    return x


_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
_WORDS = _tokens("regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')", " +")
_SALIENT = f"list_distinct(list_transform(list_filter({_tokens('text', '[^a-z0-9]+')}, lambda w: regexp_matches(w, '^[0-9]+$') or (length(w) >= 4 and w not in ({_STOP}))), lambda w: {_stem('w')}))"


def _unit_codes(s, d):
    """Codes raised for a case with the quotes of the judges that gave evidence, whose words hash to a few."""
    word = lambda i: F.concat(F.lit("w"), F.floor(uniform("token", F.col("case_id"), F.col("role"), F.col("code"), i) * 6).cast("string"))
    f = r.run_findings(s, d).select("case_id", "role", "code", "family", F.when(F.col("has_evidence"), F.array_distinct(F.array(*[word(i) for i in range(4)]))).alias("quote"))
    return f.groupBy("case_id", "code", "family").agg(F.collect_set("quote").alias("quotes"))


_UNIT_CODES = f"""uc as (select case_id, code, family, case when has_evidence then list_distinct([{', '.join(f"'w' || cast(cast(floor({_u(chr(39) + 'token' + chr(39), 'case_id', 'role', 'code', str(i))} * 6) as bigint) as varchar)" for i in range(4))}]) end as quote from run_findings),
  edges as (select distinct a.case_id, a.code as a, b.code as b from uc a join uc b on a.case_id = b.case_id and a.family = b.family and a.family <> '' and a.code <> b.code
    and len(list_intersect(a.quote, b.quote)) / least(len(a.quote), len(b.quote)) >= 0.6),
  two as (select e.case_id, e.a, f.b from edges e join edges f on e.case_id = f.case_id and e.b = f.a union select * from edges),
  four as (select e.case_id, e.a, f.b from two e join two f on e.case_id = f.case_id and e.b = f.a union select * from two),
  units as (select u.case_id, u.code, least(u.code, coalesce(min(f.b), u.code)) as unit from (select distinct case_id, code from uc) u left join four f on u.case_id = f.case_id and u.code = f.a group by u.case_id, u.code)"""


def _units(s, d):
    return units.finding_units(_unit_codes(s, d), len(r.CODES))


def _families(s):
    return r.dim_code(s).select("code", "family")


def _isa(s, d):
    """customer in nation in region as concepts."""
    n = r.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    c = r.table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    return n.unionByName(c)


def _lineage(s, d):
    """Each order is a kind of the customer's order before it, the first one of the customer, and every fiftieth customer a kind of
    its own last order: chains as long as customers have orders, and cycles."""
    o = r.table(s, d, "orders").select("o_orderkey", "o_custkey")
    before = F.expr("lag(o_orderkey) over (partition by o_custkey order by o_orderkey)")
    chain = o.select(F.concat(F.lit("o"), "o_orderkey").alias("child"), F.coalesce(F.concat(F.lit("o"), before), F.concat(F.lit("c"), "o_custkey")).alias("parent"))
    back = o.filter("o_custkey % 50 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return _isa(s, d).unionByName(chain).unionByName(back.select(F.concat(F.lit("c"), "o_custkey").alias("child"), F.concat(F.lit("o"), "last").alias("parent")))


_LINEAGE = """isa as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer
    union all select 'o' || o_orderkey, coalesce('o' || lag(o_orderkey) over (partition by o_custkey order by o_orderkey), 'c' || o_custkey) from orders
    union all select 'c' || o_custkey, 'o' || max(o_orderkey) from orders where o_custkey % 50 = 0 group by o_custkey),
  most as (select max(n) + 3 as most from (select count(*) as n from orders group by o_custkey)),
  up as (select child, parent as ancestor, 1 as distance from isa union select up.child, isa.parent, distance + 1 from up join isa on up.ancestor = isa.child where distance <= (select most from most))"""

_ISA = """isa as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
  up as (select child, parent as ancestor, 1 as distance from isa union all select a.child, b.parent, 2 from isa a join isa b on a.parent = b.child)"""


def _terms(s, d):
    c = r.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("nation"))
    pick = F.col("key") % 4
    note = F.when(pick == 0, F.col("child")).when(pick == 1, F.col("nation")).when(pick == 2, F.col("child")).otherwise("r0")
    record = F.when(pick == 0, F.col("child")).when(pick == 1, F.col("child")).when(pick == 2, F.col("nation")).otherwise(F.col("child"))
    return c.select("key", note.alias("note"), record.alias("record"))


#: field, kind, required, datatype, values (joined by |).
_SPECS = (
    ("c_name", "presence", True, "", ""),
    ("c_acctbal", "datatype", True, "decimal", ""),
    ("c_opened", "datatype", False, "date", ""),
    ("c_seen", "datatype", True, "datetime", ""),
    ("c_code", "datatype", True, "code", ""),
    ("c_mktsegment", "enum", True, "", "BUILDING|AUTOMOBILE|MACHINERY"),
    ("c_rank", "enum", False, "", "1|2"),
    ("c_nationkey", "presence", False, "", ""),
    ("c_phones", "cardinality", True, "", ""),
)


def _specs(s):
    return s.createDataFrame(list(_SPECS), "field string, kind string, required boolean, datatype string, allowed string").withColumn("allowed", F.split("allowed", r"\|"))


def _mutants(s, d):
    return datagen.mutation_battery(r.table(s, d, "customer"), "c_custkey", _specs(s))


_MUTANTS = f"""specs as (select field, kind, required, datatype, string_split(allowed, '|') as allowed from {r._values(_SPECS, 'field, kind, required, datatype, allowed')}), ops as (
  select field, kind, 'strip' as op, '<absent>' as value, case when required then 'BLOCK' else 'PASS' end as expected from specs
  union all select field, kind, 'null', null, 'BLOCK' from specs where required
  union all select field, kind, unnest(['not_in_set', 'empty', 'near_miss', 'numeric']), unnest(['__bogus__', '', allowed[1] || 'X', '123']), 'BLOCK' from specs where kind = 'enum'
  union all select field, kind, 'case_variant', lower(allowed[1]), 'BLOCK' from specs where kind = 'enum' and allowed[1] <> lower(allowed[1])
  union all select field, kind, unnest(['illegal_first_char', 'legal_prefix_then_junk', 'empty']), unnest(case datatype when 'decimal' then ['abc', '12!!34', ''] else ['not-a-date', '2026!!junk', ''] end), 'BLOCK' from specs where kind = 'datatype' and datatype in ('decimal', 'date', 'datetime')
  union all select field, kind, unnest(['illegal_first_char', 'empty']), unnest(['!!bad', '']), 'BLOCK' from specs where kind = 'datatype' and datatype not in ('decimal', 'date', 'datetime')
  union all select field, kind, unnest(['empty_array', 'scalar_not_array']), unnest(['[]', 'scalar']), 'BLOCK' from specs where kind = 'cardinality'),
  valid as (select field, kind, 'valid:' || v as op, v as value from (
    select field, kind, unnest(allowed[2:]) as v from specs where kind = 'enum' union all
    select field, kind, unnest(case datatype when 'decimal' then ['0.99', '1000000.00', '5'] when 'date' then ['2025-01-01', '1999-12-31'] else ['2027-01-15T23:59:59Z', '2026-05-30T09:00:00+05:30'] end) from specs where kind = 'datatype' and datatype in ('decimal', 'date', 'datetime'))
    union all select field, kind, 'valid:absent', '<absent>' from specs where not required),
  mutants as (select c_custkey, field, kind, op, value, expected from customer, ops)"""


def _observed(s, d):
    m = _mutants(s, d)
    return m.select("c_custkey", "field", "kind", "op", F.when(uniform("observed", F.col("c_custkey"), F.col("field"), F.col("op")) < 0.9, F.col("expected")).otherwise(F.when(F.col("expected") == "BLOCK", "PASS").otherwise("BLOCK")).alias("observed"))


_PIIN = lambda k: f"len(regexp_extract_all(text, '{t.PII[k]}'))"
_GRADE = "case x.severity when 'high' then {} when 'medium' then {} when 'low' then {} else {} end"
_RISK = f"""hits as (select conv_id, kind, k, severity, confidence, case kind when 'pii' then {_GRADE.format(0.9, 0.6, 0.3, 0.5)} when 'unsafe' then {_GRADE.format(0.8, 0.5, 0.2, 0.4)} else {_GRADE.format(0.95, 0.65, 0.35, 0.5)} end::double as factor from safety x where hit),
  marks as (select conv_id, 'turn' as kind, 0 as k, null as severity, avg(confidence) as confidence, avg({_GRADE.format(0.7, 0.4, 0.2, 0.3)}::double) * 0.3 as factor from turn_safety x where flagged group by conv_id),
  factors as (select * from hits union all select * from marks),
  alerts as (select conv_id, unnest(case kind when 'pii' then ['pii_leakage', case when severity = 'high' then 'high_risk_pii' end] when 'unsafe' then ['unsafe_response', case when severity = 'high' then 'high_risk_unsafe_content' end]
    else ['compliance_violation_' || k, case when severity = 'high' then 'high_risk_compliance' end] end) as alert from hits union all select conv_id, alert from turn_safety where alert is not null),
  risks as (select c.conv_id, round(coalesce(f.risk, 0.0), 6) as risk, round(coalesce(f.confidence, 0.0), 6) as confidence, coalesce(a.alerts, '') as alerts from (select distinct conv_id from conversations) c
    left join (select conv_id, max(factor) as risk, avg(confidence) as confidence from factors group by conv_id) f on c.conv_id = f.conv_id
    left join (select conv_id, string_agg(distinct alert, ',' order by alert) as alerts from alerts where alert is not null group by conv_id) a on c.conv_id = a.conv_id)"""

_TOP = """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])) /
            (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.v, lambda x: x * x)))) as score from e join e q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id),
            k as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s where score >= 0.1) select query_id, rank, vec_id, round(score, 6) as score from k where rank <= 3"""

QUERIES = {
    "f01_evidence_overlap": (
        lambda s, d: containment.overlap_of_all(*_spans(s, d)),
        f"""with {_claims(_tokens('text', _EV), _tokens('text', _EV))}, n as (select case_id, item_id, len(q) as q, {_common('q', 's')} as n from k)
            select case_id, item_id, round(n / q, 6) as overlap, round(n / q, 6) >= 0.8 as valid from n where n > 0""",
    ),
    "f02_containment": (
        lambda s, d: containment.containment_of_all(*_spans(s, d)),
        f"""with {_claims(_WORDS, _WORDS)}, n as (select case_id, item_id, least(len(q), len(s)) as m, {_common('q', 's')} as n from k)
            select case_id, item_id, round(n / m, 6) as containment from n where n > 0""",
    ),
    "g03_source_grounding": (
        lambda s, d: containment.grounding_of_all(*_spans(s, d)),
        f"""with {_claims(f"list_distinct(list_transform({_tokens('text', '[^a-z0-9]+')}, lambda w: {_stem('w')}))", _SALIENT)}, n as (select case_id, item_id, len(q) as salient, len(q) - {_common('q', 's')} as missing from k)
            select case_id, item_id, salient, missing, missing = 0 as disproved from n where missing < salient""",
    ),
    "g04_evidence_presence": (
        lambda s, d: containment.evidence_presence(*_spans(s, d)),
        f"""with d as materialized (select doc_id as case_id, {_plain('text')} as x, string_split({_plain('text')}, ' ') as w from documents),
            p as materialized (select item_id, {_plain('text')} as x, string_split({_plain('text')}, ' ') as w from benchmark where {_plain('text')} <> ''),
            dg as (select distinct case_id, unnest({_runs('w')}) as g from d), pg as (select distinct item_id, unnest({_runs('w')}) as g from p where len(w) >= {containment.RUN + 2}), near as (select distinct case_id, item_id from dg join pg using (g)),
            pairs as (select case_id, item_id, p.x as quote, contains(d.x, p.x) as within from near join d using (case_id) join p using (item_id)
              union all select case_id, item_id, p.x, true from d join p on len(p.w) < {containment.RUN + 2} and contains(d.x, p.x))
            select case_id, item_id, length(quote) >= 12 and within as present from pairs""",
    ),
    "g10_value_presence": (
        lambda s, d: grounding.value_presence(r.table(s, d, "documents"), VALUE),
        sql(f"""with k as (select doc_id, list_distinct(regexp_extract_all(split_part(text, chr(10), 1), '{VALUE}')) as v, lower(substr(text, instr(text, chr(10)) + 1)) as rest from documents)
            select doc_id as case_id, len(v) as checked, case when len(v) > 0 then len(list_filter(v, lambda x: contains(rest, x))) = len(v) end as conforms from k"""),
    ),
    "f13_pii_scan": (lambda s, d: grounding.pii_scan(r.table(s, d, "documents")), f"select doc_id, {', '.join(f'{_PIIN(k)} as {k}' for k in t.PII)} from documents"),
    "f13_pii_spans": (
        lambda s, d: grounding.pii_spans(r.table(s, d, "documents")),
        " union all ".join(
            f"""select doc_id, '{k}' as kind, start, value, substr(text, greatest(start - {t.CONTEXT}, 0) + 1, least(start, {t.CONTEXT}) + length(value) + {t.CONTEXT}) as context from (
            select doc_id, text, found[i] as value, cast(coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as start
            from (select doc_id, text, regexp_extract_all(text, '{p}') as found, regexp_split_to_array(text, '{p}') as between from documents where regexp_matches(text, '{p}')), range(1, 100000) n(i) where i <= len(found))"""
            for k, p in t.PII.items()
        ),
    ),
    "f14_redaction": (
        lambda s, d: grounding.redaction(r.table(s, d, "documents")),
        rf"with k as (select doc_id, {_redacted('text')} as x from documents) select doc_id, length(x) as n_chars, md5(x) as digest, len(regexp_extract_all(x, '\[REDACTED_[A-Z]+\]')) as marks from k",
    ),
    "g02_item_presence": (
        lambda s, d: grounding.medication_presence(r.table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), r.table(s, d, "documents").select(F.col("doc_id").alias("key"), "text")),
        "select p_partkey as key, len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda w: length(w) >= 4 and contains(lower(text), w))) > 0 as disproved from part join documents on p_partkey = doc_id",
    ),
    "t03_kb_topk": (
        lambda s, d: neighbours.top_matches(r.table(s, d, "embeddings").filter(F.col("vec_id") % 100 == 0), r.table(s, d, "embeddings"), 3, 0.1),
        _TOP,
    ),
    "g17_finding_units": (lambda s, d: _units(s, d), sql(f"with {_UNIT_CODES} select * from units", "run_findings")),
    "a21_unit_scores": (
        lambda s, d: units.unit_scores(_units(s, d), r.run_gold(s, d), _families(s)),
        sql(
            f"""with {_UNIT_CODES}, named as (select case_id, g.code, family from run_gold g join dim_code c on g.code = c.code),
            closure as (select case_id, c.code from named n join dim_code c on n.family = c.family and n.family <> '' union select case_id, code from named),
            u as (select count(*) as units, count(*) filter (hit) as tp from (select units.case_id, unit, bool_or(c.code is not null) as hit from units left join closure c on units.case_id = c.case_id and units.code = c.code group by all)),
            f as (select distinct u.case_id, family from units u join dim_code c on u.code = c.code where family <> ''),
            g as (select count(*) as gold, count(*) filter (u.code is not null or f.family is not null) as caught from named n left join units u on n.case_id = u.case_id and n.code = u.code left join f on n.case_id = f.case_id and n.family = f.family)
            select units, tp, gold, caught, round(tp / nullif(units, 0), 3) as precision, round(caught / nullif(gold, 0), 3) as recall from u, g""",
            "run_findings",
            "run_gold",
        ),
    ),
    "a22_pass_scores": (
        lambda s, d: units.pass_scores(r.findings(s, d), r.gold_codes(s, d)),
        sql(
            """with r as (select distinct run, case_id, code from findings), n as (select run, count(*) as raised, count(g.code) as tp, (select count(*) from gold_codes) as gold from r left join gold_codes g on r.case_id = g.case_id and r.code = g.code group by run)
            select *, round(tp / nullif(raised, 0), 3) as precision, round(tp / nullif(gold, 0), 3) as recall from n""",
            "findings",
            "gold_codes",
        ),
    ),
    "a22_headline": (
        lambda s, d: units.headline(units.pass_scores(r.findings(s, d), r.gold_codes(s, d)), "recall"),
        sql(
            """with r as (select distinct run, case_id, code from findings), n as (select run, round(count(g.code) / (select count(*) from gold_codes), 3) as x from r left join gold_codes g on r.case_id = g.case_id and r.code = g.code group by run)
            select count(x) as n, round(avg(x), 6) as mean, min(x) as least, max(x) as most, round(max(x) - min(x), 6) as spread, count(x) < 3 as below_target from n""",
            "findings",
            "gold_codes",
        ),
    ),
    "j19_isa_closure": (lambda s, d: hierarchy.closure(_isa(s, d)), sql(f"with {_ISA} select child, ancestor, cast(min(distance) as integer) as distance from up group by child, ancestor")),
    "j19_lineage_closure": (lambda s, d: hierarchy.closure(_lineage(s, d)), f"with recursive {_LINEAGE} select child, ancestor, cast(min(distance) as integer) as distance from up group by child, ancestor"),
    "g09_subsumption": (
        lambda s, d: units.subsumption_verdicts(_terms(s, d), hierarchy.closure(_isa(s, d))),
        sql(
            f"""with {_ISA}, t as (select c_custkey as key, case c_custkey % 4 when 0 then 'c' || c_custkey when 1 then 'n' || c_nationkey when 2 then 'c' || c_custkey else 'r0' end as note,
            case c_custkey % 4 when 2 then 'n' || c_nationkey else 'c' || c_custkey end as record from customer)
            select key, note, record, case when note = record or exists (select 1 from up where child = record and ancestor = note) then 'SUPPRESS' when exists (select 1 from up where child = note and ancestor = record) then 'STAND' else 'DEFER' end as verdict from t"""
        ),
    ),
    "a34_sentiment": (
        lambda s, d: kpi.speaker_sentiment(r.turns(s, d)),
        sql(
            """with s as (select conv_id, role, count(*) as turns, sum(sentiment * confidence) / sum(case when confidence = 0 then 1.0 else confidence end) as x from turns group by conv_id, role)
            select conv_id, role, turns, round(x, 4) as sentiment, case when x > 0.15 then 'positive' when x < -0.15 then 'negative' else 'neutral' end as label from s""",
            "turns",
        ),
    ),
    "a35_risk": (lambda s, d: kpi.risk(r.calls(s, d).select("conv_id"), r.safety(s, d), r.turn_safety(s, d)), sql(f"with {_RISK} select * from risks", "safety", "turn_safety")),
    "a37_kpi_score": (
        lambda s, d: kpi.overall(r.calls(s, d), kpi.risk(r.calls(s, d).select("conv_id"), r.safety(s, d), r.turn_safety(s, d)), r.safety(s, d)),
        sql(
            f"""with {_RISK}, broken as (select conv_id, sum(case severity when 'high' then 40 when 'medium' then 25 else 15 end + case when confidence > 0.8 then 10 else 0 end)::double as loss from safety where hit and kind = 'compliance' group by conv_id),
            p as (select c.conv_id,
              case when has_core then 100 - case when latency_ms > 5000 then 20 when latency_ms > 3000 then 10 else 0 end - 5 * interruptions - 3 * repetitions - 2 * silences end as core,
              case when has_quality then 100 - case when intent_match then 0 else 20 end - 10 * (1 - intent_confidence) - case when hallucination then 30 else 0 end - case when deviation then 15 else 0 end - case when completed then 10 * (1 - completion_confidence) else 25 end end as quality,
              case when has_sentiment then 100 - case user_mood when 'negative' then 30 when 'neutral' then 10 else 0 end - 5 * (1 - user_confidence) - case when agent_mood = 'negative' then 10 else 0 end - case when frustration then 15 else 0 end - case when escalation then 10 else 0 end end as sentiment,
              100 - 60 * risk - coalesce(loss, 0.0) - case when contains(alerts, 'high_risk_pii') then 20 else 0 end - case when contains(alerts, 'high_risk_unsafe_content') then 20 else 0 end - case when contains(alerts, 'high_risk_compliance') then 30 else 0 end as safety,
              case when has_technical then case when mos is not null then 20 * (mos - 1) when audio is not null then 100 * audio - case when distorted then 15 else 0 end - case when snr < 10 then 20 when snr < 20 then 10 else 0 end else 100.0 end
                - 5 * tool_errors - case when processing_ms > 60000 then 10 when processing_ms > 30000 then 5 else 0 end - case when available then 0 else 15 end end as technical
              from calls c join risks k on c.conv_id = k.conv_id left join broken b on c.conv_id = b.conv_id),
            q as (select conv_id, {', '.join(f"case when {x} is not null then least(100.0, greatest(0.0, {x})) end as {x}" for x in ('core', 'quality', 'sentiment', 'safety', 'technical'))} from p)
            select conv_id, round(core, 6) as core, round(quality, 6) as quality, round(sentiment, 6) as sentiment, round(safety, 6) as safety, round(technical, 6) as technical,
            round((0.20 * coalesce(core, 0) + 0.25 * coalesce(quality, 0) + 0.15 * coalesce(sentiment, 0) + 0.25 * safety + 0.15 * coalesce(technical, 0)) /
              (0.25 + case when core is not null then 0.20 else 0.0 end + case when quality is not null then 0.25 else 0.0 end + case when sentiment is not null then 0.15 else 0.0 end + case when technical is not null then 0.15 else 0.0 end), 2) as score from q""",
            "safety",
            "turn_safety",
            "calls",
        ),
    ),
    "d01_case_verdicts": (
        lambda s, d: datagen.package_cases(r.gold_codes(s, d), r.dim_code(s)),
        sql(
            """with g as (select case_id, min(tier) as tier, string_agg(code, ',' order by code) as codes from gold_codes join dim_code using (code) group by case_id)
            select case_id, 'case-' || substr(sha1(case_id || '|' || codes), 1, 12) as packaged_id, codes, case tier when 1 then 'reject' when 2 then 'needs_review,reject' else 'approve,needs_review' end as expected,
            case when cast('0x' || substr(sha1('split|' || case_id), 1, 8) as bigint) % 100 < 30 then 'test' else 'train' end as split from g""",
            "gold_codes",
        ),
    ),
    "d02_mutants": (lambda s, d: _mutants(s, d), f"with {_MUTANTS} select * from mutants"),
    "d03_valid_variations": (
        lambda s, d: datagen.valid_variations(r.table(s, d, "customer"), "c_custkey", _specs(s)),
        f"with {_MUTANTS} select c_custkey, field, kind, op, value, 'PASS' as expected from customer, valid",
    ),
    "d03_mutant_cases": (
        lambda s, d: datagen.mutant_cases(_mutants(s, d), "c_custkey", "battery"),
        f"with {_MUTANTS} select 'battery_' || c_custkey || '_' || field || ':' || op as case_id, 'battery' as pack, expected as expected_structural_verdict, 'mutation:' || op as defect_type, field as mutated_field from mutants",
    ),
    "a27_mutation_score": (
        lambda s, d: datagen.mutation_score(_mutants(s, d), _observed(s, d), "c_custkey"),
        f"""with {_MUTANTS}, o as (select *, case when {_u("'observed'", 'c_custkey', 'field', 'op')} < 0.9 then expected when expected = 'BLOCK' then 'PASS' else 'BLOCK' end as observed from mutants)
            select kind, count(*) filter (expected = 'BLOCK') as defects, count(*) filter (expected = 'BLOCK' and observed = 'BLOCK') as killed, count(*) filter (expected = 'PASS' and observed = 'BLOCK') as false_blocks,
            round(count(*) filter (expected = 'BLOCK' and observed = 'BLOCK') / nullif(count(*) filter (expected = 'BLOCK'), 0), 4) as score from o group by kind""",
    ),
    "j15_encounter": (
        lambda s, d: datagen.encounters(*(r.table(s, d, x) for x in ("customer", "orders", "lineitem", "part"))),
        """with t as (select l_orderkey, string_agg(distinct p_type, '|' order by p_type) as items, count(*) as n from lineitem join part on l_partkey = p_partkey group by l_orderkey)
            select o_orderkey, c_custkey, c_mktsegment, coalesce(items, '') as items, coalesce(n, 0) as n_items from orders join customer on o_custkey = c_custkey left join t on o_orderkey = l_orderkey""",
    ),
    "j16_first_with_item": (
        lambda s, d: datagen.first_with_item(*(r.table(s, d, x) for x in ("orders", "lineitem", "part")), "PROMO"),
        """select o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) as o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO') group by o_custkey""",
    ),
    "t06_positive_first": (
        lambda s, d: datagen.positive_first(r.cases(s, d)).select("position", "case_id", "gold_block"),
        sql("select row_number() over (order by coalesce(gold_block, false) desc, case_id) - 1 as position, case_id, gold_block from cases", "cases"),
    ),
}
