"""Queries of reports, projections, orders and scalar rules over records, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import records as fr
from assaylake.functions.hashing import uniform
from assaylake.operators import grounding, neighbours, rollup
from assaylake.operators import reports as op
from assaylake.plans.consensus import _BUCKETS, _buckets
from assaylake.plans.statistics import _GRADED, _PHI
from assaylake.plans.text import _EV, _MUTANTS, _TOP, _common, _mutants, _observed, _tokens as _split_tokens
from assaylake.sources import relations as r
from assaylake.sources import stores
from assaylake.sources.relations import _u, sql

RESAMPLES = 1000
_DRAWS = " + ".join(f"cast(u >= {p}::double * 4294967296 as integer)" for p in op.POISSON)
_MIXED = "cast((cast('0x' || substr(sha1('boot|' || cast(case_id as varchar)), 1, 8) as bigint) + b * 2654435761) % 4294967296 as ubigint)"
for _shift, _factor in op.MIXER:
    _MIXED = f"list_transform([{_MIXED}], lambda x: (xor(x, x >> {_shift}) * {_factor}) % 4294967296)[1]"


def _rates(s, d):
    return rollup.case_rollup(r.votes(s, d)).select("case_id", "match_rate")


_RATES = """runs as (select case_id, run, any_value(gold_block) as g, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p from votes group by case_id, run),
  rates as (select case_id, round(avg(cast((b >= w and b >= p) = g as double)), 4) as match_rate from runs group by case_id)"""


def _extracted(s, d):
    """Records of events by type, and how many each type should have given."""
    e = r.table(s, d, "events").select(F.col("event_type").alias("template"), "event_id", F.when(F.col("event_id") % 97 > 0, F.col("value")).alias("value"), "user_id")
    expected = e.groupBy("template").agg(F.count(F.lit(1)).alias("n")).select("template", F.when(F.col("template") == "click", F.col("n")).otherwise(F.col("n") + 10).alias("expected_count"))
    return op.extraction_score(e, expected, F.col("value").isNotNull() & F.col("user_id").isNotNull())


_ARGS = {"k": "^-?[0-9]+$", "who": "^[a-z]+$"}


def _arguments(s, d):
    e = r.table(s, d, "events").select("event_id", F.to_json(F.struct(F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).alias("k"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise("9").alias("who"))).alias("body"))
    return op.argument_score(e, "body", _ARGS).select("event_id", "missing", "wrong", "graded", "accepted")


def _gate(s, d):
    f = r.run_findings(s, d).select("case_id", "role", "code")
    cases = r.run_votes(s, d).groupBy("case_id").agg(F.first("gold_block").alias("expected_block"))
    return op.corpus_gate(f.withColumn("cleared", uniform("clear", F.col("case_id"), F.col("code")) < 0.6), cases)


def _blobs(s, d):
    v = r.run_log(s, d)
    semantic = F.when(F.col("seq") % 2 == 0, F.struct(F.struct(F.col("verdict").alias("verdict")).alias("semantic")))
    return v.select(F.col("seq").cast("string").alias("run"), F.to_json(F.struct("verdict", F.lit("allow").alias("gate_decision"), F.when(F.col("seq") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("findings"), semantic.alias("stage_results"))).alias("body"))


def _patients(s, d):
    c = r.table(s, d, "customer")
    name = F.array(F.struct(F.array(F.col("c_name")).alias("given"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("family")))
    gender = F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("odd")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), name.alias("name"), gender.alias("gender"), F.when(F.col("c_custkey") % 2 == 0, "1980-02-03").alias("birthDate"))).alias("body"))


def _pack_join(s, d):
    """Runs with their pack's row; the pack lacks some cases, and only a clean one counts as such."""
    pack = r.cases(s, d).filter("case_id % 3 > 0").select("case_id", (~F.col("gold_block")).alias("clean_negative"))
    j = rollup.compose_runs(r.votes(s, d)).join(pack, "case_id", "left")
    state = F.when(F.col("clean_negative"), "clean").when(F.col("clean_negative").isNull(), "unknown").otherwise("defect")
    return j.groupBy(state.alias("state"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def _arms(s, d):
    """The first and the second run as two arms: agreement, and each arm's share that agrees with gold."""
    v = r.votes(s, d)
    ok = ((F.col("vote") == "BLOCK") == F.col("gold_block")).cast("double")
    by = v.filter("run < 2").groupBy("role", "case_id").agg(F.max(F.when(F.col("run") == 0, F.col("vote"))).alias("a"), F.max(F.when(F.col("run") == 1, F.col("vote"))).alias("b"), F.max(F.when(F.col("run") == 0, ok)).alias("oa"), F.max(F.when(F.col("run") == 1, ok)).alias("ob"))
    return by.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("a") == F.col("b")).cast("double")), 2).alias("agreement_percent"), F.round(F.avg("oa"), 6).alias("score_a"), F.round(F.avg("ob"), 6).alias("score_b"))


def _post(s, d):
    """Codes left after the service's suppressions, the offline ones and the reference codes."""
    f = r.run_findings(s, d).select("case_id", "code").distinct()
    drop = lambda name, p: f.filter(uniform(name, F.col("case_id"), F.col("code")) < p)
    left = f.join(drop("service", 0.2), ["case_id", "code"], "left_anti").join(drop("offline", 0.3), ["case_id", "code"], "left_anti")
    return left.join(r.dim_code(s).filter("not gradeable").select("code"), "code", "left_anti").select("case_id", "code")


def _survivors(s, d):
    lived = _observed(s, d).filter("observed = 'PASS'").select("c_custkey", "field", "op")
    return _mutants(s, d).filter("expected = 'BLOCK'").join(lived, ["c_custkey", "field", "op"], "left_semi").select("c_custkey", "field", "op", "value")


def _order(s, d):
    e = r.table(s, d, "embeddings")
    top = neighbours.top_matches(e.filter(F.col("vec_id") % 100 == 0), e, 3, 0.1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id"))), lambda x: x["vec_id"].cast("string"))
    return top.groupBy("query_id").agg(F.array_join(ordered, ",").alias("retrieval_order")).withColumn("context_hash", F.sha2(F.concat(F.lit("q"), F.col("query_id")), 256))


def _excerpt(s, d):
    """What a prompt gets of a conversation: the first ten turns, three hundred characters of each."""
    first = r.table(s, d, "conversations").withColumn("k", F.expr("row_number() over (partition by conv_id order by turn, text)")).filter("k <= 10")
    t = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 300).alias("text")))).alias("x"))
    cut = F.array_join(F.transform("x", lambda e: e["text"]), "\n")
    return t.select("conv_id", F.size("x").cast("long").alias("turns"), F.md5(cut).alias("digest"))


def _candidates(s, d):
    e = r.run_log(s, d)
    return op.best_candidate(e.select("case_key", F.col("seq").alias("place"), (uniform("accept", F.col("seq")) < 0.05).alias("accepted"), F.round(uniform("graded", F.col("seq")), 3).alias("graded")), "case_key")


def _names(s, d):
    p = r.table(s, d, "part")
    words = F.concat(F.lit("Take "), F.col("p_size"), F.lit(".5 MG of "), "p_name")
    named = F.concat(F.lit("Case_0"), F.col("p_partkey"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("Kidney", "Diabetes", "HIV test", "plain")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(" (disorder) "))
    return p.select(
        "p_partkey",
        fr.dose(F.when(F.col("p_partkey") % 3 > 0, words).otherwise("none")).alias("dose"),
        fr.without_suffix(F.concat("p_brand", F.lit("77"))).alias("name"),
        fr.case_number(named).alias("number"),
        fr.specialty(named).alias("specialty"),
        fr.semantic_tag(named).alias("tag"),
        fr.term(named).alias("term"),
        F.array_join(fr.item_tokens(words, r"\d+(\.\d+)?\s*mg", 3, ("take",)), ",").alias("tokens"),
    )


_NAMED = "'Case_0' || p_partkey || ' ' || (['Kidney', 'Diabetes', 'HIV test', 'plain'])[p_partkey % 4 + 1] || ' (disorder) '"
_TERM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _claims(s, d):
    p = r.table(s, d, "part").select("p_partkey", "p_name", F.concat(F.col("p_brand"), F.lit(" "), F.reverse(F.split("p_name", " "))[0], F.lit(" x")).alias("chunk"))
    values = F.concat("p_name", F.lit(" "), F.upper("p_name"))
    return p.select("p_partkey", fr.claim_in_chunk(F.col("p_name"), F.col("chunk")).alias("claimed"), fr.stands_whole(F.split("p_name", " ")[0], F.col("chunk")).alias("whole"), F.array_join(fr.first_values(values, "[a-z]+"), ",").alias("found"))


def _cleaned(s, d):
    x = F.concat_ws("\n", F.lit(" <!-- verification -->"), F.col("text"), F.lit("\n\n\nend"), F.lit("<!-- /verification -->"))
    y = fr.clean_lines(x)
    fenced = F.concat(F.lit("```yaml\n"), F.col("text"), F.lit("\n```"))
    z = fr.without_fence(F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text")))
    return r.table(s, d, "documents").filter("text is not null").select("doc_id", F.length(y).cast("long").alias("n"), F.md5(y).alias("digest"), F.md5(z).alias("unfenced"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _scrubbed(s, d):
    """Every line of each text without its second sentence; lines of which nothing is left go."""
    parts = lambda line: F.filter(F.split(line, r"(?<=[.!?]) +"), lambda x: x != "")
    second = lambda line: F.slice(parts(line), 2, 1)
    lines = F.split("text", "\n")
    kept = F.array_compact(F.transform(lines, lambda x: F.when(F.size(parts(x)) > 1, fr.without_sentences(x, second(x))).otherwise(x)))
    n = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.size(parts(x)))
    return r.table(s, d, "documents").filter("text is not null").select("doc_id", n.alias("parts"), F.md5(F.array_join(kept, "\n")).alias("digest"))


def _tokens(s, d):
    u = lambda n: uniform(n, F.col("event_id"))
    word = F.element_at(F.array(*[F.lit(x) for x in ('"Approve"', "needs_review,", " REJECT", "other")]), (F.floor(u("word") * 4) + 1).cast("int"))
    lp = F.when(u("lp") < 0.1, 0.5).otherwise(F.round(-3 * u("lp"), 4))
    tokens = F.array(F.struct(F.lit("the").alias("token"), F.lit(-0.1).cast("double").alias("logprob")), F.struct(word.alias("token"), lp.alias("logprob")))
    score = F.when(u("word") < 0.9, F.round(u("reward"), 4))
    decision = F.element_at(F.array(*[F.lit(x) for x in ("reject", "needs_review", "approve", "odd")]), (F.floor(u("word") * 4) + 1).cast("int"))
    return r.table(s, d, "events").select("event_id", fr.verdict_confidence(tokens).alias("confidence"), fr.reward_verdict(score, 0.6).alias("reward"), fr.decision_score(decision).alias("score"))


def _chunks(s, d):
    k = F.col("page_id")
    return r.table(s, d, "pages").select("page_id", fr.chunk_id(F.when(k % 3 == 0, F.concat(F.lit(" p"), k)).otherwise(F.lit(" ")), F.when(k % 3 == 1, F.col("url")), text=F.when(k % 9 != 2, F.col("html"))).alias("chunk"))


def _signature(s, d):
    """Signature of each agent's grading configuration, and of its cohort's sorted ids."""
    e = r.run_log(s, d).groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("signature").alias("config"), F.array_join(F.array_sort(F.collect_set(F.col("case_key").cast("string"))), "\n").alias("ids"))
    body = stores.canonical_json(models=F.lit("m-1"), agent=F.col("agent"), config=F.col("config"), n=F.col("n"))
    return e.select("agent", F.sha2(body, 256).alias("signature"), F.sha2(F.concat("ids", F.lit("\n")), 256).alias("cohort"))


def _panels(s, d):
    n = r.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    panel = F.slice("names", F.lit(1), (F.col("n_regionkey") % 3).cast("int"))
    return op.recommendation(n.select("n_regionkey", panel.alias("panel"), F.slice("names", 1, 2).alias("selectable"))).select("n_regionkey", "mode", "reviewer", "k")


def _writes(s, d):
    w = r.run_log(s, d).select("case_key", "seq", F.when(F.col("seq") % 11 > 0, F.col("verdict")).alias("verdict"))
    return op.audited(w, "case_key", "seq", "verdict").select("case_key", "seq", "before", "after", "action")


def _timeline(s, d):
    """The last runs of each case with gold, the newest judgement and the segment of their signature."""
    log = r.run_log(s, d)
    gold = r.cases(s, d).select(F.col("case_id").alias("case_key"), F.col("gold_block").alias("gold"))
    judged = log.filter("agent = 'view'").groupBy("case_key").agg(F.max_by("verdict", "seq").alias("judgement"))
    t = op.timeline(log.select("case_key", "seq", "verdict", "signature"), "case_key", "seq", 50)
    return t.join(gold, "case_key", "left").join(judged, "case_key", "left").selectExpr("case_key", "seq", "verdict", "cast(place as bigint) as place", "cast(segment as bigint) as segment", "gold", "judgement")


def _injected(s, d):
    """Texts with a defect put in by the injector that applies first: a line dropped, a value changed, a mark added; with the recipe."""
    text, lines = F.col("text"), F.split("text", "\n")
    many = F.size(lines) > 3
    digit = text.rlike("[0-9]")
    body = F.when(many, F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), F.slice(lines, F.lit(3), F.size(lines))), "\n")).when(digit, F.regexp_replace(text, "[0-9]", "0")).otherwise(F.concat(text, F.lit(" [sic]")))
    kind = F.when(many, "drop_line").when(digit, "change_value").otherwise("add_mark")
    return r.table(s, d, "documents").filter("text is not null").select("doc_id", kind.alias("defect_type"), F.md5(body).alias("digest"))


TYPES = ["drop_line", "change_value", "add_mark"]


def _injections(s, d):
    """Each text with one defect, its recipe, and whether the recipe makes the same text again."""
    from assaylake.operators import injectors

    clean = r.table(s, d, "documents").select("doc_id", "text")
    made = injectors.inject(clean, "doc_id", "text", TYPES)
    again = injectors.replayed(clean, made, "doc_id", "text").select("doc_id", F.col("text").alias("again"))
    j = made.join(again, "doc_id")
    return j.select("doc_id", "recipe.defect_type", "recipe.safety_flag", "recipe.start", F.md5("recipe.pre_value").alias("pre"), "recipe.post_value", "recipe.expected", F.md5("text").alias("digest"), F.col("text").eqNullSafe(F.col("again")).alias("replays"))


_SEED = "cast('0x' || substr(sha1('inject|' || cast(doc_id as varchar)), 1, 8) as bigint)"
_SUM = "coalesce(cast(list_sum(list_transform({}, lambda x: length(x))) as bigint), 0)"
_INJECTED = f"""k as (select doc_id, text, {_SEED} as seed, string_split(text, chr(10)) as l, regexp_extract_all(text, '[0-9]+') as f, regexp_split_to_array(text, '[0-9]+') as b from documents),
  o as (select *, seed % greatest(len(l) - 1, 1) as i, seed % greatest(len(f), 1) as j, list_filter([case when len(l) > 3 then 'drop_line' end, case when len(f) > 0 then 'change_value' end, 'add_mark'], lambda x: x is not null) as opts from k),
  p as (select *, opts[seed % len(opts) + 1] as kind from o),
  q as (select *, case kind when 'drop_line' then {_SUM.format('l[1:i]')} + i when 'change_value' then {_SUM.format('b[1:j + 1]')} + {_SUM.format('f[1:j]')} else length(text) end as start,
    case kind when 'drop_line' then l[i + 1] || chr(10) when 'change_value' then f[j + 1] else '' end as pre from p),
  z as (select *, case kind when 'drop_line' then '' when 'change_value' then translate(pre, '0123456789', '1234567890') else ' [sic]' end as post from q)"""


def _expected(s, d):
    """Runs against the set of verdicts that their case expects."""
    from assaylake.operators import records

    raw = F.when(F.col("case_id") % 5 == 0, None).when(F.col("case_id") % 5 == 1, '["needs_review", "reject"]').otherwise(F.when(F.col("gold_block"), "reject").otherwise("approve"))
    v = rollup.compose_runs(r.votes(s, d)).withColumn("expected", records.expected_set(raw))
    observed = F.when(F.col("verdict") == "BLOCK", "reject").when(F.col("verdict") == "WARN", "needs_review").otherwise("approve")
    return v.select("case_id", "run", F.array_join("expected", ",").alias("expected"), records.expects_block(F.col("expected")).alias("block"), records.matches_expected(observed, F.col("expected")).alias("match"))


def _parsed(s, d):
    """Replies with a JSON object in a fence, bare, or none."""
    from assaylake.sources import io

    t = r.turns(s, d)
    body = F.to_json(F.struct(F.round("sentiment", 3).alias("sentiment"), F.col("role").alias("who")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is "), body)).otherwise("I cannot tell.")
    return t.withColumn("x", io.fenced_json(reply, "sentiment double, who string")).select("conv_id", "turn", "x.sentiment", "x.who")


def _spans(s, d):
    """Each text in thirds, as transcript, source and artifact, and a quote of one of them or of none."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    cut = lambda a, n: F.when(k % 5 > 0, F.substring(text, a, n)).otherwise("")
    quote = F.when(k % 2 == 0, F.substring(text, 2 * third + 10, F.lit(60))).otherwise(F.concat(F.substring(text, 1, 60), F.lit(" never said here")))
    return r.table(s, d, "documents").select(k.alias("case_id"), F.when(k % 3 == 0, "MISSING_ALLERGY").otherwise("FABRICATION").alias("code"), quote.alias("quote"), cut(F.lit(1), third).alias("transcript"), cut(third + 1, third).alias("source"), cut(2 * third + 1, F.length(text)).alias("artifact"))


_THIRD = "(length(coalesce(text, '')) // 3)"
_SPAN = f"substr(coalesce(text, ''), {{}} * {_THIRD} + 1, {{}})"


def _stage_votes(s, d):
    v = r.run_votes(s, d).groupBy("case_id")
    return v.agg(*[F.max(F.when(F.col("role") == role, F.col("vote"))).alias(stage) for role, stage in (("policy", "structural"), ("risk", "semantic"), ("faithfulness", "artifact"))])


def _worst(s, d):
    from assaylake.operators import records

    return _stage_votes(s, d).select("case_id", records.worst_with_artifact(F.col("structural"), F.col("semantic"), F.col("artifact")).alias("verdict"))


def _gold_verdicts(s, d):
    from assaylake.operators import records

    c = r.cases(s, d).select("case_id", F.when(F.col("case_id") % 4 == 0, F.when(F.col("gold_block"), "BLOCK").when(~F.col("gold_block"), "PASS")).alias("declared"))
    return records.gold_verdicts(c, r.gold_codes(s, d))


def _cohort_rows(s, d):
    """Rows of a cohort with its gold: the unlabeled are listed and counted apart from the measures."""
    v = r.cases(s, d)
    graded = rollup.compose_runs(r.votes(s, d)).select("case_id", F.col("verdict"), "run")
    j = v.join(graded, "case_id", "left")
    ok = (F.col("verdict") == "BLOCK") == F.col("gold_block")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count_if("labeled").alias("labeled"), F.count_if(F.col("labeled") & ok).alias("right"))


QUERIES = {
    "c01_valid_spans": (
        lambda s, d: grounding.valid_spans(_spans(s, d)),
        f"""with k as (select doc_id, case when doc_id % 3 = 0 then 'MISSING_ALLERGY' else 'FABRICATION' end as code, case when doc_id % 2 = 0 then substr(coalesce(text, ''), 2 * {_THIRD} + 10, 60) else substr(coalesce(text, ''), 1, 60) || ' never said here' end as quote,
            case when doc_id % 5 > 0 then {_SPAN.format(0, _THIRD)} || chr(10) || {_SPAN.format(1, _THIRD)} || case when doc_id % 3 > 0 then chr(10) || {_SPAN.format(2, 'length(text)')} else '' end else '' end as corpus from documents),
            w as (select *, {_split_tokens('quote', _EV)} as q, {_split_tokens('corpus', _EV)} as c from k)
            select doc_id as case_id, code, trim(replace(corpus, chr(10), ' ')) = '' or (len(q) > 0 and {_common('q', 'c')} / len(q) >= 0.8) as valid from w""",
    ),
    "f37_worst_with_artifact": (
        _worst,
        sql(
            """with s as (select case_id, max(vote) filter (role = 'policy') as a, max(vote) filter (role = 'risk') as b, max(vote) filter (role = 'faithfulness') as c from run_votes group by case_id)
            select case_id, case when 'BLOCK' in (a, b, c) then 'BLOCK' when 'WARN' in (a, b) then 'WARN' else 'PASS' end as verdict from s""",
            "run_votes",
        ),
    ),
    "p07_gold_verdicts": (
        _gold_verdicts,
        sql(
            """with x as (select c.case_id, coalesce(case when c.case_id % 4 = 0 then case when gold_block then 'BLOCK' when not gold_block then 'PASS' end end, case when c.case_id in (select case_id from gold_codes) then 'BLOCK' end) as v from cases c)
            select case_id, v as gold_verdict from x where v is not null""",
            "gold_codes",
        ),
    ),
    "j02_cohort_rows": (
        _cohort_rows,
        sql(
            """with g as (select case_id, run, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p from votes group by case_id, run)
            select lang, count(*) as rows, count(*) filter (labeled) as labeled, count(*) filter (labeled and (b >= w and b >= p) = gold_block) as right from cases c left join g on c.case_id = g.case_id group by lang""",
            "cases",
            "votes",
        ).replace(" as rows,", ' as "rows",').replace(" as right from", ' as "right" from'),
    ),
    "w03_versions_newest_first": (
        lambda s, d: r.run_log(s, d).select("agent", "case_key", "seq", F.expr("row_number() over (partition by agent, case_key order by seq desc)").cast("long").alias("back")),
        sql("select agent, case_key, seq, row_number() over (partition by agent, case_key order by seq desc) as back from run_log", "run_log"),
    ),
    "p01_expected_match": (
        _expected,
        sql(
            """with r as (select case_id, run, any_value(gold_block) as g, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p from votes group by case_id, run),
            x as (select case_id, run, case when case_id % 5 = 0 then [] when case_id % 5 = 1 then ['needs_review', 'reject'] when g then ['reject'] else ['approve'] end as e, case when b >= w and b >= p then 'reject' when w >= p then 'needs_review' else 'approve' end as o from r)
            select case_id, run, array_to_string(e, ',') as expected, list_contains(e, 'reject') as block, list_contains(e, o) as match from x""",
            "votes",
        ),
    ),
    "p21_run_summary": (
        lambda s, d: _blobs(s, d).select(F.col("run").alias("run_id"), F.get_json_object("body", "$.verdict").alias("verdict"), F.get_json_object("body", "$.gate_decision").alias("decision"), F.get_json_object("body", "$.stage_results.semantic").isNotNull().alias("semantic")),
        sql("select cast(seq as varchar) as run_id, verdict, 'allow' as decision, seq % 2 = 0 as semantic from run_log", "run_log"),
    ),
    "k02_parsed_replies": (_parsed, sql("select conv_id, turn, case when turn % 3 < 2 then round(sentiment, 3) end as sentiment, case when turn % 3 < 2 then role end as who from turns", "turns")),
    "a04_bootstrap": (
        lambda s, d: op.bootstrap(_rates(s, d), "case_id", "match_rate", RESAMPLES),
        sql(
            f"""with {_RATES}, d as (select b, match_rate as x, {_MIXED}::double as u from rates, range(0, {RESAMPLES}) n(b)), w as (select b, x, {_DRAWS} as w from d),
            m as (select list(m order by m) as m from (select b, sum(w * x) / sum(w) as m from w group by b))
            select round(m[{int(RESAMPLES * 0.025) + 1}], 6) as ci_low, round(m[{int(RESAMPLES * 0.975) + 1}], 6) as ci_high, cast(len(m) as integer) as resamples from m""",
            "votes",
        ),
    ),
    "a03_mean_kappa": (
        lambda s, d: op.mean_kappa(r.votes(s, d)),
        sql(
            """with c as (select case_id, run, vote, count(*) as c from votes group by all), i as (select case_id, run, sum(c) as n, sum(c * (c - 1)) as agree from c group by all),
            pe as (select case_id, sum(cast(c as double) * c) / (cast(sum(c) as double) * sum(c)) as pe from (select case_id, vote, sum(c) as c from c group by all) group by case_id),
            p as (select case_id, avg(cast(agree as double) / (n * (n - 1))) as p from i group by case_id), k as (select case when pe >= 1 then 1.0 else round((p - pe) / (1 - pe), 6) end as kappa from p join pe using (case_id))
            select count(kappa) as cases, round(avg(kappa), 6) as mean_kappa from k""",
            "votes",
        ),
    ),
    "a17_reliability": (
        lambda s, d: op.reliability_report(r.votes(s, d)),
        sql(
            f"""{_PHI}, {_GRADED}, c as (select case_id, run, vote, count(*) as c from votes group by all), i as (select case_id, run, sum(c) as n, sum(c * (c - 1)) as agree from c group by all),
            pe as (select sum(cast(c as double) * c) / (cast(sum(c) as double) * sum(c)) as pe from (select vote, sum(c) as c from c group by all)),
            n2 as (select count(*) as n, count(*) filter ((vote = 'BLOCK') = gold_block) as same, count(*) filter (vote = 'BLOCK') as p1, count(*) filter (gold_block) as g1 from votes),
            bins as (select greatest(ceil(confidence * 10) - 1, 0) as bin, count(*) as n, avg(confidence) as conf, avg(cast(ok as double)) as acc from g where confidence is not null group by 1),
            q as (select role, case_id, vote, count(*) as c from votes group by all), s as (select role, case_id, max(c) / sum(c) as m, sum(c) as n from q group by all),
            st as (select role, count(*) as cases, round(1 - avg(1 - m), 6) as stability from s where n >= 2 group by role), k as (select count(distinct role) as k from votes), f as (select count(phi) as pairs, round(avg(phi), 6) as r from phi),
            m as (select 'inter_judge_kappa' as metric, count(*) as n, round((avg(cast(agree as double) / (i.n * (i.n - 1))) - any_value(pe)) / (1 - any_value(pe)), 6) as value from i, pe
              union all select 'cohen_kappa_vs_gold', n, round((same / cast(n as double) - (p1 * g1 + (n - p1) * (n - g1)) / (cast(n as double) * n)) / (1 - (p1 * g1 + (n - p1) * (n - g1)) / (cast(n as double) * n)), 6) from n2
              union all select 'ece', cast(sum(n) as bigint), round(sum(n * abs(acc - conf)) / sum(n), 6) from bins
              union all select 'brier', count(*), round(avg((confidence - cast(ok as double)) * (confidence - cast(ok as double))), 6) from g where confidence is not null
              union all select 'error_phi', pairs, r from f union all select 'effective_votes', k, round(k / (1 + (k - 1) * r), 6) from k, f
              union all select 'intra_judge_stability', cast(sum(cases) as bigint), round(avg(stability), 6) from st
              union all select 'selective_accuracy', count(*), round(avg(cast(ok as double)), 6) from g where vote <> 'WARN')
            select metric, n, value, value is null as insufficient from m""",
            "votes",
        ),
    ),
    "a25_extraction_score": (
        _extracted,
        """with e as (select event_type as template, count(*) as n, count(*) filter (event_id % 97 = 0 or value is null or user_id is null) as nulls from events group by 1), x as (select *, case when template = 'click' then n else n + 10 end as want from e)
            select template, want as expected_count, n as count, nulls, n > 0 and n = want and nulls = 0 as accepted, case when n > 0 and n = want and nulls = 0 then 1.0 else round(least(n, want) / want * (n - nulls) / n, 3) end as graded from x""",
    ),
    "a26_argument_score": (
        _arguments,
        """with x as (select event_id, event_id % 3 = 0 as m, event_id % 5 = 0 as w from events) select event_id, case when m then 'k' else '' end as missing, case when w then 'who' else '' end as wrong, round((2 - m::int - w::int) / 2, 3) as graded, not m and not w as accepted from x""",
    ),
    "a28_corpus_gate": (
        _gate,
        sql(
            f"""with f as (select case_id, bool_and(u < 0.6) as all_cleared, bool_or(u >= 0.6) as stands from (select case_id, {_u("'clear'", 'case_id', 'code')} as u from run_findings) group by case_id),
            j as (select v.case_id, b, case when b then coalesce(stands, false) else coalesce(all_cleared, false) end as fine from (select case_id, any_value(gold_block) as b from run_votes group by case_id) v left join f on v.case_id = f.case_id)
            select count(*) filter (b) as positives, count(*) filter (b and fine) as standing, count(*) filter (not b) as negatives, count(*) filter (not b and fine) as cleared, bool_and(fine) as passed from j""",
            "run_votes",
            "run_findings",
        ),
    ),
    "a32_arm_scores": (
        _arms,
        sql(
            """select a.role, count(*) as n, round(100 * avg(cast(a.vote = b.vote as double)), 2) as agreement_percent, round(avg(cast((a.vote = 'BLOCK') = a.gold_block as double)), 6) as score_a, round(avg(cast((b.vote = 'BLOCK') = b.gold_block as double)), 6) as score_b
            from votes a join votes b on a.case_id = b.case_id and a.role = b.role and a.run = 0 and b.run = 1 group by a.role""",
            "votes",
        ),
    ),
    "a42_usage": (
        lambda s, d: op.usage(r.run_log(s, d).select("case_key", F.when(F.col("seq") % 4 > 0, F.col("seq") % 50).alias("tokens_in"), F.when(F.col("seq") % 4 == 1, F.lit(3)).alias("tokens_out")), "case_key"),
        sql("select case_key, cast(sum(case when seq % 4 > 0 then seq % 50 else 0 end) as bigint) as tokens_in, cast(sum(case when seq % 4 = 1 then 3 else 0 end) as bigint) as tokens_out from run_log group by case_key having tokens_in > 0 or tokens_out > 0", "run_log"),
    ),
    "p10_by_ids": (
        lambda s, d: r.cases(s, d).join(r.table(s, d, "customer").select(F.col("c_custkey").alias("case_id")), "case_id", "left_semi").select("case_id", "lang"),
        sql("select case_id, lang from cases where case_id in (select c_custkey from customer)", "cases"),
    ),
    "p11_known_with_evidence": (
        lambda s, d: r.run_findings(s, d).filter("has_evidence").join(r.dim_code(s).filter("code <> 'style'").select("code"), "code", "left_semi").select("case_id", "role", "code"),
        sql("select case_id, role, code from run_findings where has_evidence and code <> 'style'", "run_findings"),
    ),
    "p14_reference_partition": (
        lambda s, d: r.run_findings(s, d).select("code").join(r.dim_code(s).filter("code <> 'tone'").select("code", "gradeable"), "code", "left").groupBy("code", F.when(F.col("gradeable"), "grade").when(~F.col("gradeable"), "skip").otherwise("keep").alias("part")).agg(F.count(F.lit(1)).alias("n")),
        sql("select code, case when code = 'tone' then 'keep' when gradeable then 'grade' else 'skip' end as part, count(*) as n from run_findings group by 1, 2", "run_findings"),
    ),
    "p22_composite_report": (
        lambda s, d: op.composite_report(_buckets(s, d)),
        sql(
            f"""with {_BUCKETS}, n as (select case_id, coalesce(max(weight) filter (bucket = 'active'), 0.0) as score, count(*) filter (bucket = 'active') as active, count(*) filter (bucket = 'suppressed') as suppressed, count(*) filter (bucket = 'ungrounded') as u, count(*) filter (bucket = 'skipped_non_gradeable') as k from buckets group by case_id)
            select case_id, case when score >= 0.5 then 'reject' when score > 0 then 'needs_review' else 'approve' end as verdict, score, active, suppressed, active || ' active, ' || suppressed || ' suppressed, ' || u || ' ungrounded, ' || k || ' skipped' as reasoning from n""",
            "run_findings",
        ),
    ),
    "p23_demographics": (
        lambda s, d: op.demographics(_patients(s, d), "body"),
        "select cast(c_custkey as varchar) as patient_id, c_name as first_name, case when c_custkey % 4 > 0 then c_mktsegment else '' end as last_name, case when c_custkey % 2 = 0 then '1980-02-03' else '1900-01-01' end as dob, case c_custkey % 3 when 0 then 'M' when 1 then 'F' else 'U' end as gender from customer",
    ),
    "p25_reshaped_runs": (
        lambda s, d: op.reshaped(_blobs(s, d), "body", "run"),
        sql("select verdict, 'allow' as decision, cast(case when seq % 3 = 0 then 2 else 0 end as bigint) as findings, 'NOT_APPLICABLE' as structural, case when seq % 2 = 0 then verdict else 'NOT_APPLICABLE' end as semantic, 'replay-' || seq as run_id, cast(seq as varchar) as replay_of from run_log", "run_log"),
    ),
    "j01_runs_and_pack": (
        _pack_join,
        sql(
            """with r as (select case_id, run, count(*) filter (vote = 'BLOCK') as b, count(*) filter (vote = 'WARN') as w, count(*) filter (vote = 'PASS') as p from votes group by case_id, run)
            select case when r.case_id % 3 > 0 and not gold_block then 'clean' when r.case_id % 3 > 0 and gold_block then 'defect' else 'unknown' end as state, case when b >= w and b >= p then 'BLOCK' when w >= p then 'WARN' else 'PASS' end as verdict, count(*) as n
            from r left join cases c on r.case_id = c.case_id group by 1, 2""",
            "cases",
            "votes",
        ),
    ),
    "j12_source_labels": (
        lambda s, d: r.table(s, d, "documents").select("doc_id", "lang").join(r.table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce(F.col("quality").cast("long"), F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("long"), F.lit(-1)).alias("toxic")),
        "select d.doc_id, lang, coalesce(cast(quality as bigint), -1) as quality, coalesce(cast(toxic as bigint), -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id",
    ),
    "u09_post_set": (
        _post,
        sql(f"select distinct case_id, code from run_findings where {_u(chr(39) + 'service' + chr(39), 'case_id', 'code')} >= 0.2 and {_u(chr(39) + 'offline' + chr(39), 'case_id', 'code')} >= 0.3 and gradeable", "run_findings"),
    ),
    "u12_survivors": (_survivors, f"""with {_MUTANTS} select c_custkey, field, op, value from mutants where expected = 'BLOCK' and {_u("'observed'", 'c_custkey', 'field', 'op')} >= 0.9"""),
    "t04_retrieval_order": (
        _order,
        f"with t as ({_TOP}) select query_id, string_agg(cast(vec_id as varchar), ',' order by score desc, vec_id) as retrieval_order, sha256('q' || query_id) as context_hash from t group by query_id",
    ),
    "t05_excerpt": (
        _excerpt,
        "with k as (select *, row_number() over (partition by conv_id order by turn, text) as k from conversations) select conv_id, count(*) as turns, md5(string_agg(substr(text, 1, 300), chr(10) order by k)) as digest from k where k <= 10 group by conv_id",
    ),
    "t08_first_patients": (lambda s, d: r.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("patient_id")).orderBy("patient_id").limit(25), "select cast(c_custkey as varchar) as patient_id from customer order by 1 limit 25"),
    "t09_best_candidate": (
        _candidates,
        sql(
            f"""with c as (select case_key, seq as place, {_u("'accept'", 'seq')} < 0.05 as accepted, round({_u("'graded'", 'seq')}, 3) as graded from run_log)
            select case_key, place, accepted, graded from (select *, row_number() over (partition by case_key order by accepted desc, case when accepted then 0 else graded end desc, place) as k from c) where k = 1""",
            "run_log",
        ),
    ),
    "w07_projection": (
        lambda s, d: stores.Provenance(r.run_log(s, d)).latest_for().select("agent", "case_key", "verdict", "seq"),
        sql("select agent, case_key, verdict, seq from (select *, row_number() over (partition by agent, case_key order by seq desc) as k from run_log) where k = 1", "run_log"),
    ),
    "w13_first_values": (
        lambda s, d: r.turns(s, d).groupBy("conv_id").agg(F.min_by("role", F.when(F.col("sentiment") < 0, F.col("turn"))).alias("chunk"), F.min_by("latency_ms", F.when(F.col("latency_ms") > 2000, F.col("turn"))).alias("start_ms")),
        sql("select conv_id, arg_min(role, turn) filter (sentiment < 0) as chunk, arg_min(latency_ms, turn) filter (latency_ms > 2000) as start_ms from turns group by conv_id", "turns"),
    ),
    "w15_timeline": (
        _timeline,
        sql(
            """with t as (select * from (select *, row_number() over (partition by case_key order by seq desc) as back from run_log) where back <= 50), c as (select *, case when signature is not distinct from lag(signature) over w and row_number() over w > 1 then 0 else 1 end as change, row_number() over w as place from t window w as (partition by case_key order by seq))
            select c.case_key, seq, verdict, place, cast(sum(change) over (partition by c.case_key order by seq rows unbounded preceding) as bigint) as segment, g.gold_block as gold, j.judgement from c left join cases g on c.case_key = g.case_id
            left join (select case_key, arg_max(verdict, seq) as judgement from run_log where agent = 'view' group by case_key) j on c.case_key = j.case_key""",
            "cases",
            "run_log",
        ),
    ),
    "l07_audited_writes": (
        _writes,
        sql("with w as (select case_key, seq, case when seq % 11 > 0 then verdict end as after from run_log), b as (select *, lag(after) over (partition by case_key order by seq) as before from w) select case_key, seq, before, after, case when before is null then 'create' when after is null then 'delete' else 'update' end as action from b", "run_log"),
    ),
    "l09_recommendation": (
        _panels,
        """with n as (select n_regionkey, list(n_name order by n_name) as names from nation group by 1), p as (select n_regionkey, names[1:n_regionkey % 3] as panel, names[1:2] as sel from n)
            select n_regionkey, case when len(panel) >= 2 then 'panel' else 'single' end as mode, case when len(panel) < 2 then sel[len(panel) + 1] end as reviewer, case when len(panel) < 2 then 5 end as k from p""",
    ),
    "l10_history": (
        lambda s, d: r.run_log(s, d).join(r.table(s, d, "customer").select(F.col("c_custkey").alias("case_key")), "case_key", "left_semi").select("case_key", "seq", "agent", "verdict"),
        sql("select case_key, seq, agent, verdict from run_log where case_key in (select c_custkey from customer)", "run_log"),
    ),
    "f06_names": (
        _names,
        f"""select p_partkey, case when p_partkey % 3 > 0 then p_size || '.5 MG' else 'as directed' end as dose, regexp_replace(p_brand || '77', '[0-9]+$', '') as name, cast(p_partkey as bigint) as number,
            case p_partkey % 4 when 0 then 'nephrology' when 1 then 'endocrinology' when 2 then 'neurology' else 'general' end as specialty, 'disorder' as tag, {_TERM.format(_NAMED)} as term,
            array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower('take   of ' || p_name), '[^a-z]+'), lambda w: length(w) >= 3 and w <> 'take'), lambda w: w), lambda w: true), ',') as tokens from part""",
    ),
    "f10_claims": (
        _claims,
        f"""with k as (select p_partkey, p_name, p_brand || ' ' || list_reverse(string_split(p_name, ' '))[1] || ' x' as chunk from part)
            select p_partkey, len(list_intersect(list_filter(string_split({_TERM.format('p_name')}, ' '), lambda w: length(w) >= 4), string_split({_TERM.format('chunk')}, ' '))) > 0 as claimed,
            contains(' ' || {_TERM.format('chunk')} || ' ', ' ' || {_TERM.format("string_split(p_name, ' ')[1]")} || ' ') as whole,
            array_to_string(list_filter(list_transform(range(1, len(regexp_extract_all(p_name, '(?i)[a-z]+')) + 1), lambda i: case when list_position(list_transform(regexp_extract_all(p_name, '(?i)[a-z]+'), lambda x: lower(x)), lower(regexp_extract_all(p_name, '(?i)[a-z]+')[i])) = i then regexp_extract_all(p_name, '(?i)[a-z]+')[i] end), lambda x: x is not null), ',') as found from k""",
    ),
    "f17_clean_lines": (
        _cleaned,
        f"""with k as (select doc_id, {_TRIM.format("replace(array_to_string(list_filter(string_split(text || chr(10) || chr(10) || chr(10) || chr(10) || 'end', chr(10)), lambda x: trim(x) not in ('<!-- verification -->', '<!-- /verification -->')), chr(10)), repeat(chr(10), 3), repeat(chr(10), 2))")} as y, {_TRIM.format("text")} as z from documents where text is not null)
            select doc_id, length(y) as n, md5(y) as digest, md5(z) as unfenced from k""",
    ),
    "f18_scrubbed": (
        _scrubbed,
        """with k as (select doc_id, list_transform(string_split(text, chr(10)), lambda l: struct_pack(l := l, p := list_filter(string_split(regexp_replace(l, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))) as lines from documents where text is not null),
            z as (select doc_id, list_transform(lines, lambda a: case when len(a.p) > 1 then case when len(list_filter(a.p, lambda x: x <> a.p[2])) > 0 then array_to_string(list_filter(a.p, lambda x: x <> a.p[2]), ' ') end else a.l end) as kept, cast(list_sum(list_transform(lines, lambda a: len(a.p))) as bigint) as parts from k)
            select doc_id, parts, md5(coalesce(array_to_string(list_filter(kept, lambda x: x is not null), chr(10)), '')) as digest from z""",
    ),
    "f19_chunk_ids": (
        _chunks,
        """select page_id, case when page_id % 3 = 0 then 'p' || page_id when page_id % 3 = 1 and trim(coalesce(url, '')) <> '' then trim(url) when page_id % 9 <> 2 then nullif(regexp_replace(regexp_replace(lower(substr(trim(html), 1, 16)), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'), '') end as chunk from pages""",
    ),
    "f31_confidence": (
        _tokens,
        f"""with k as (select event_id, {_u("'word'", 'event_id')} as w, {_u("'lp'", 'event_id')} as l, {_u("'reward'", 'event_id')} as x from events)
            select event_id, case when w >= 0.75 then null when l < 0.1 then 1.0 else round(exp(round(-3 * l, 4)), 6) end as confidence, case when w < 0.9 then case when round(x, 4) >= 0.6 then 'approve' else 'reject' end end as reward,
            case when w < 0.25 then 0.0 when w < 0.5 then 0.5 when w < 0.75 then 1.0 end::double as score from k""",
    ),
    "f34_signatures": (
        _signature,
        sql(
            """with n as (select agent, count(*) as n, max(signature) as config, string_agg(distinct cast(case_key as varchar), chr(10) order by cast(case_key as varchar)) as ids from run_log group by agent)
            select agent, sha256('{"agent": "' || agent || '", "config": "' || config || '", "models": "m-1", "n": "' || n || '"}') as signature, sha256(ids || chr(10)) as cohort from n""",
            "run_log",
        ),
    ),
    "d05_injections": (
        _injections,
        f"""with {_INJECTED} select doc_id, kind as defect_type, case kind when 'drop_line' then 'omission' when 'change_value' then 'contradiction' else 'format' end as safety_flag, start, md5(pre) as pre, post as post_value,
            case kind when 'add_mark' then 'WARN' else 'BLOCK' end as expected, md5(substr(text, 1, start) || post || substr(text, start + length(pre) + 1)) as digest, true as replays from z""",
    ),
    "d05_injected": (
        _injected,
        """with k as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null) select doc_id, case when len(l) > 3 then 'drop_line' when regexp_matches(text, '[0-9]') then 'change_value' else 'add_mark' end as defect_type,
            md5(case when len(l) > 3 then array_to_string(list_concat(l[1:1], l[3:]), chr(10)) when regexp_matches(text, '[0-9]') then regexp_replace(text, '[0-9]', '0', 'g') else text || ' [sic]' end) as digest from k""",
    ),
}
