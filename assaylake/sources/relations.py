"""Evaluation relations derived from the test tables, with their SQL twins.

Judge votes, findings and run logs are made from labels and events by content hashes, so both engines derive the same
rows. Dimensions are small literals and are broadcast by size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.hashing import uniform

#: role, share of flipped votes
ROLES = (("faithfulness", 0.10), ("policy", 0.20), ("risk", 0.15))
RUNS = 10
#: code, tier, pillar, family, owner ("" for none), severity, gradeable
CODES = (
    ("contradiction", 1, "conversation", "grounding", "faithfulness", "HIGH", True),
    ("fabrication", 1, "artifact", "grounding", "faithfulness", "HIGH", True),
    ("omission", 1, "artifact", "grounding", "", "HIGH", True),
    ("privacy_leak", 1, "conversation", "safety", "policy", "HIGH", True),
    ("unsafe_advice", 1, "dual", "safety", "risk", "HIGH", True),
    ("format", 2, "artifact", "", "policy", "MEDIUM", True),
    ("tone", 2, "conversation", "", "", "MEDIUM", True),
    ("style", 3, "dual", "", "", "LOW", False),
)
SEVERITY = (("HIGH", 1.0), ("MEDIUM", 0.5), ("LOW", 0.2))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dim_role(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "role string, rate double")


def dim_code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODES), "code string, tier int, pillar string, family string, owner string, severity string, gradeable boolean")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, labeled, gold_block (null where unlabeled), lang, source of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    gold = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("gold_block"))
    return d.join(gold, "doc_id", "left").select(F.col("doc_id").alias("case_id"), F.col("gold_block").isNotNull().alias("labeled"), "gold_block", "lang", "source")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, role, run, gold_block, vote, confidence: ten runs of three judges over the labeled cases."""
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("gold_block"))
    rows = gold.crossJoin(F.broadcast(dim_role(spark))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    u, base = uniform("vote", F.col("case_id"), F.col("role"), F.col("run")), F.col("gold_block")
    vote = F.when(F.col("u") < F.col("rate") * 0.4, "WARN").when(F.col("u") < F.col("rate"), F.when(base, "PASS").otherwise("BLOCK")).otherwise(F.when(base, "BLOCK").otherwise("PASS"))
    confidence = F.when(F.col("role") != "faithfulness", F.round(0.5 + uniform("conf", F.col("case_id"), F.col("role"), F.col("run")) / 2, 6))
    return rows.withColumn("u", u).select("case_id", "role", "run", "gold_block", vote.alias("vote"), confidence.alias("confidence"))


def findings(spark: SparkSession, sf_dir: str, run: int | None = None) -> DataFrame:
    """case_id, role, run, vote, code, has_evidence and the code's dimension columns: what the judges raised."""
    v = votes(spark, sf_dir)
    if run is not None:
        v = v.filter(F.col("run") == run)
    keys = [F.col(c) for c in ("case_id", "role", "run", "code")]
    p = F.when(F.col("vote") == "BLOCK", 0.35).when(F.col("vote") == "WARN", 0.15).otherwise(0.02)
    return v.crossJoin(F.broadcast(dim_code(spark))).filter(uniform("find", *keys) < p).withColumn("has_evidence", uniform("evidence", *keys) < 0.7)


def per_run(rows: DataFrame) -> DataFrame:
    """Each run of a case as a case of its own."""
    return rows.withColumn("case_id", F.col("case_id") * RUNS + F.col("run"))


def run_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_run(votes(spark, sf_dir))


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_run(findings(spark, sf_dir))


def run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeled cases of every run."""
    rows = cases(spark, sf_dir).filter("labeled").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    return per_run(rows)


def run_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold codes of every run of a case."""
    return per_run(gold_codes(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))).drop("run")


def gold_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, code: the codes that the blocked labeled cases hold."""
    gold = cases(spark, sf_dir).filter("gold_block").select("case_id")
    return gold.crossJoin(F.broadcast(dim_code(spark).select("code"))).filter(uniform("gold", F.col("case_id"), F.col("code")) < 0.4)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, agent, case_key, ts, verdict, signature, replay_of (null if authoritative) from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("agent"),
        F.col("user_id").alias("case_key"),
        "ts",
        F.when(F.col("value") > 60, "BLOCK").when(F.col("value") > 30, "WARN").otherwise("PASS").alias("verdict"),
        F.concat(F.lit("sig"), F.floor(F.dayofmonth("ts") / 7).cast("string")).alias("signature"),
        F.when(k % 2 == 0, F.concat(F.lit("run-"), F.col("event_id").cast("string"))).alias("replay_of"),
        "value",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text with a sentiment in [-1, 1], its confidence (some 0) and a latency in ms."""
    t = table(spark, sf_dir, "conversations")
    key = [F.col("conv_id"), F.col("turn")]
    c = uniform("turn-conf", *key)
    return t.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.round(uniform("sentiment", *key) * 2 - 1, 6).alias("sentiment"),
        F.when(c < 0.1, 0.0).otherwise(F.round(c, 6)).alias("confidence"),
        F.floor(uniform("latency", *key) * 4000).cast("long").alias("latency_ms"),
    )


_SEVERITIES = "case when {u} < 0.3 then 'high' when {u} < 0.6 then 'medium' when {u} < 0.9 then 'low' else 'odd' end"


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, kind, k, hit, severity, confidence: what a safety judge said about each conversation."""
    kinds = spark.createDataFrame([("pii", 0), ("unsafe", 0), ("compliance", 0), ("compliance", 1)], "kind string, k int")
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().crossJoin(F.broadcast(kinds))
    key = [F.col("conv_id"), F.col("kind"), F.col("k")]
    rows = rows.withColumn("u", uniform("safety-severity", *key))
    return rows.select("conv_id", "kind", "k", (uniform("safety-hit", *key) < 0.35).alias("hit"), F.expr(_SEVERITIES.format(u="u")).alias("severity"), F.round(uniform("safety-conf", *key), 6).alias("confidence"))


def turn_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, flagged, severity, confidence, alert (null without one) of each turn."""
    key = [F.col("conv_id"), F.col("turn")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", uniform("turn-severity", *key).alias("u"), (uniform("turn-flag", *key) < 0.1).alias("flagged"), F.round(uniform("turn-safe", *key), 6).alias("confidence"))
    return rows.select("conv_id", "turn", "flagged", F.expr(_SEVERITIES.format(u="u")).alias("severity"), "confidence", F.when(F.col("flagged") & (F.col("u") < 0.3), "turn_risk").alias("alert"))


#: Measures of a conversation, as SQL over U('name'), a hash of the name and the conversation.
_CALLS = {
    "has_core": "U('has-core') < 0.9",
    "latency_ms": "case when U('latency?') < 0.9 then floor(U('call-latency') * 8000) end",
    "interruptions": "floor(U('interruptions') * 5)",
    "repetitions": "floor(U('repetitions') * 5)",
    "silences": "floor(U('silences') * 5)",
    "has_quality": "U('has-quality') < 0.9",
    "intent_match": "U('intent') < 0.8",
    "intent_confidence": "round(U('intent-conf'), 6)",
    "hallucination": "U('hallucination') < 0.2",
    "deviation": "U('deviation') < 0.2",
    "completed": "U('completed') < 0.7",
    "completion_confidence": "round(U('completion'), 6)",
    "has_sentiment": "U('has-sentiment') < 0.9",
    "user_mood": "case when U('user-mood') < 0.3 then 'negative' when U('user-mood') < 0.6 then 'neutral' else 'positive' end",
    "user_confidence": "round(U('user-conf'), 6)",
    "agent_mood": "case when U('agent-mood') < 0.2 then 'negative' else 'neutral' end",
    "frustration": "U('frustration') < 0.2",
    "escalation": "U('escalation') < 0.1",
    "has_technical": "U('has-technical') < 0.9",
    "mos": "case when U('mos?') < 0.5 then round(1 + 4 * U('mos'), 6) end",
    "audio": "case when U('audio?') < 0.8 then round(U('audio'), 6) end",
    "distorted": "U('distorted') < 0.2",
    "snr": "case when U('snr?') < 0.8 then round(40 * U('snr'), 6) end",
    "tool_errors": "floor(U('tools') * 3)",
    "processing_ms": "case when U('processing?') < 0.8 then floor(U('processing') * 90000) end",
    "available": "U('available') < 0.95",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and the measures of _CALLS."""
    u = r"(cast(conv(substr(sha1(concat_ws('|', \1, cast(conv_id as string))), 1, 8), 16, 10) as double) / 4294967296D)"
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", *[F.expr(re.sub(r"U\(('[^']*')\)", u, x)).alias(c) for c, x in _CALLS.items()])


def _values(rows: tuple, names: str) -> str:
    def lit(x: object) -> str:
        return "true" if x is True else "false" if x is False else f"cast({x!r} as double)" if isinstance(x, float) else repr(x)

    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def _u(*values: str) -> str:
    joined = " || '|' || ".join(f"cast({v} as varchar)" for v in values)
    return f"(cast('0x' || substr(sha1({joined}), 1, 8) as bigint) / 4294967296.0)"


#: Common table expressions of the relations above for the SQL twins.
SQL = {
    "dim_role": f"select * from {_values(ROLES, 'role, rate')}",
    "dim_code": f"select * from {_values(CODES, 'code, tier, pillar, family, owner, severity, gradeable')}",
    "cases": """select d.doc_id as case_id, l.doc_id is not null as labeled, (l.toxic = 1 or l.quality = 0) as gold_block, d.lang, d.source
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "votes": f"""select case_id, role, run, gold_block,
        case when u < rate * 0.4 then 'WARN' when u < rate then case when gold_block then 'PASS' else 'BLOCK' end when gold_block then 'BLOCK' else 'PASS' end as vote,
        case when role <> 'faithfulness' then round(0.5 + {_u("'conf'", 'case_id', 'role', 'run')} / 2, 6) end as confidence
        from (select l.doc_id as case_id, (l.toxic = 1 or l.quality = 0) as gold_block, role, rate, cast(run as integer) as run,
              {_u("'vote'", 'l.doc_id', 'role', 'run')} as u from labels l, dim_role, range(0, {RUNS}) r(run))""",
    "findings": f"""select v.*, c.*, {_u("'evidence'", 'case_id', 'role', 'run', 'code')} < 0.7 as has_evidence from votes v, dim_code c
        where {_u("'find'", 'case_id', 'role', 'run', 'code')} < case vote when 'BLOCK' then 0.35 when 'WARN' then 0.15 else 0.02 end""",
    "run_votes": f"select * replace (case_id * {RUNS} + run as case_id) from votes",
    "run_findings": f"select * replace (case_id * {RUNS} + run as case_id) from findings",
    "run_gold": f"select case_id * {RUNS} + run as case_id, code from gold_codes, range(0, {RUNS}) r(run)",
    "gold_codes": f"select case_id, code from cases, dim_code where gold_block and {_u("'gold'", 'case_id', 'code')} < 0.4",
    "run_log": """select event_id as seq, event_type as agent, user_id as case_key, ts,
        case when value > 60 then 'BLOCK' when value > 30 then 'WARN' else 'PASS' end as verdict,
        'sig' || cast(cast(floor(day(ts) / 7) as bigint) as varchar) as signature,
        case when cast(json_extract_string(props, '$.k') as integer) % 2 = 0 then 'run-' || cast(event_id as varchar) end as replay_of, value from events""",
    "safety": f"""select conv_id, kind, k, {_u("'safety-hit'", 'conv_id', 'kind', 'k')} < 0.35 as hit, {_SEVERITIES.format(u=_u("'safety-severity'", 'conv_id', 'kind', 'k'))} as severity, round({_u("'safety-conf'", 'conv_id', 'kind', 'k')}, 6) as confidence
        from (select distinct conv_id from conversations), (values ('pii', 0), ('unsafe', 0), ('compliance', 0), ('compliance', 1)) kinds(kind, k)""",
    "turn_safety": f"""select conv_id, turn, {_u("'turn-flag'", 'conv_id', 'turn')} < 0.1 as flagged, {_SEVERITIES.format(u=_u("'turn-severity'", 'conv_id', 'turn'))} as severity, round({_u("'turn-safe'", 'conv_id', 'turn')}, 6) as confidence,
        case when {_u("'turn-flag'", 'conv_id', 'turn')} < 0.1 and {_u("'turn-severity'", 'conv_id', 'turn')} < 0.3 then 'turn_risk' end as alert from conversations""",
    "calls": "select conv_id, " + ", ".join(f"{re.sub(r"U\(('[^']*')\)", lambda m: _u(m[1], 'conv_id'), x)} as {c}" for c, x in _CALLS.items()) + " from (select distinct conv_id from conversations)",
    "turns": f"""select conv_id, turn, role, text, round({_u("'sentiment'", 'conv_id', 'turn')} * 2 - 1, 6) as sentiment,
        case when {_u("'turn-conf'", 'conv_id', 'turn')} < 0.1 then 0.0 else round({_u("'turn-conf'", 'conv_id', 'turn')}, 6) end as confidence,
        cast(floor({_u("'latency'", 'conv_id', 'turn')} * 4000) as bigint) as latency_ms from conversations""",
}
_NEEDS = {"run_votes": ("dim_role", "votes"), "run_findings": ("dim_role", "votes", "dim_code", "findings"), "run_gold": ("cases", "dim_code", "gold_codes"), "votes": ("dim_role",), "findings": ("dim_role", "votes", "dim_code"), "gold_codes": ("cases", "dim_code")}


def sql(body: str, *names: str) -> str:
    """``body`` with the relations that it names, and what they need, before it. A body that starts with ``with`` goes on from them."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    ctes = ", ".join(f"{n} as ({SQL[n]})" for n in order)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes}, {body[5:]}" if ctes else body
    return f"with {ctes} {body}" if ctes else body
