"""Queries that write derived records with a sink and read them back with its source, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.sources import io, stores
from assaylake.sources import relations as r
from assaylake.sources.committed import CommittedStore
from assaylake.sources.relations import sql

_VERDICT = "case when gold_block then 'reject' when not gold_block then 'approve' end"
DOCUMENT = "workspace_id string, id long, seq long, created_at string, fk long, verdict string, body string"


def _cases(s, d):
    """Cases in the shape of a pack."""
    expected = F.when(F.col("gold_block"), F.array(F.lit("reject"))).when(~F.col("gold_block"), F.array(F.lit("approve")))
    c = r.cases(s, d)
    return c.select(F.col("case_id").cast("string").alias("case_id"), F.col("source").alias("pack"), F.col("lang").alias("agent_type"), expected.alias("expected_verdict"), (~F.col("gold_block")).alias("clean_negative"))


def pack_scan(s, d):
    path = stores.shared_folder(s, "pack")
    _cases(s, d).write.json(path)
    return io.read_ndjson(s, path, schemas.CASE, strict=True).select("case_id", "pack", "agent_type", F.array_join("expected_verdict", ",").alias("expected"), "clean_negative")


def _runs(s, d):
    v = r.votes(s, d)
    return v.groupBy("case_id", "run").agg(F.max(F.when(F.col("vote") == "BLOCK", 2).when(F.col("vote") == "WARN", 1).otherwise(0)).alias("rank")).select(
        F.col("case_id").cast("string").alias("case_id"), F.concat(F.lit("p"), F.col("case_id") % 3).alias("pack"), F.col("run").alias("run_index"), F.when(F.col("rank") == 2, "BLOCK").when(F.col("rank") == 1, "WARN").otherwise("PASS").alias("verdict")
    )


_RUNS = "select case_id, 'p' || case_id % 3 as pack, run, case max(case vote when 'BLOCK' then 2 when 'WARN' then 1 else 0 end) when 2 then 'BLOCK' when 1 then 'WARN' else 'PASS' end as verdict from votes group by case_id, run"


def run_scan(s, d):
    path = stores.shared_folder(s, "runs")
    _runs(s, d).write.json(path)
    return io.read_ndjson(s, path, schemas.RUN, strict=True).select("case_id", "pack", "run_index", "verdict")


def run_sink(s, d):
    path = stores.shared_folder(s, "runs")
    io.write_runs(_runs(s, d), path)
    rows = s.read.schema("case_id string, run_index int, verdict string, pack string").parquet(path)
    return rows.groupBy("pack", "verdict").agg(F.count(F.lit(1)).alias("n"))


def case_sink(s, d):
    path = stores.shared_folder(s, "cases")
    c = r.cases(s, d)
    text = stores.canonical_json(source=F.col("source"), lang=F.col("lang"), case_id=F.col("case_id"), verdict=F.when(F.col("gold_block"), "reject"))
    c.select(text.alias("value")).write.text(path)
    return s.read.schema("value string").text(path).select(F.get_json_object("value", "$.case_id").alias("case_id"), F.sha2("value", 256).alias("sha256"))


def _corrections(s, d):
    """A suppression of every gradeable finding, whose split follows its case's hash."""
    from assaylake.functions.hashing import split_of

    f = r.run_findings(s, d).filter("gradeable").select("case_id", "code").distinct()
    text = lambda x: F.lit(x)
    return f.select(text("1").alias("schema_version"), F.col("case_id").cast("string").alias("case_id"), text("suppress").alias("action"), F.col("code").alias("flag_code"), text("BLOCK").alias("verdict_before"), text("PASS").alias("verdict_after"), text("presence").alias("contract"), split_of(F.col("case_id")).alias("split"))


def correction_log(s, d):
    """Two appends to a log that was not there before."""
    path = stores.shared_folder(s, "corrections")
    rows, before = _corrections(s, d), io.read_or_empty(s, path, schemas.CORRECTION)
    first = before.agg(F.count(F.lit(1)).alias("before"))
    for action in ("suppress", "inject"):
        io.append_ndjson(rows.withColumn("action", F.lit(action)), path)
    return io.read_or_empty(s, path, schemas.CORRECTION).groupBy("action", "flag_code").agg(F.count(F.lit(1)).alias("n")).crossJoin(first)


def corpus_split(s, d):
    path = stores.shared_folder(s, "corpus")
    io.write_corpus(_corrections(s, d), path)
    return io.read_corpus(s, path, "test").groupBy("flag_code").agg(F.count(F.lit(1)).alias("n"))


def cohort_csv(s, d):
    path = stores.shared_folder(s, "cohort")
    c = r.table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    c.write.option("header", True).csv(path)
    return io.read_cohort_csv(s, path)


def bundles(s, d):
    """One bundle for each nation, written line by line: its patient and a condition for every customer."""
    path = stores.shared_folder(s, "bundles")
    n, c = r.table(s, d, "nation"), r.table(s, d, "customer")
    entry = lambda kind, id_: F.concat(F.lit('{"resource": '), F.to_json(F.struct(F.lit(kind).alias("resourceType"), id_.alias("id"))), F.lit("}"))
    line = lambda df, key, place, value: df.select(F.col(key).alias("n_nationkey"), F.lit(place).alias("place"), value.alias("value"))
    lines = line(n, "n_nationkey", 0, F.lit('{"resourceType": "Bundle", "entry": ['))
    lines = lines.unionByName(line(n, "n_nationkey", 1, entry("Patient", F.concat(F.lit("n"), F.col("n_nationkey")))))
    lines = lines.unionByName(line(c, "c_nationkey", 2, F.concat(F.lit(","), entry("Condition", F.col("c_custkey").cast("string")))))
    lines = lines.unionByName(line(n, "n_nationkey", 3, F.lit("]}")))
    lines.repartition("n_nationkey").sortWithinPartitions("n_nationkey", "place").drop("place").write.partitionBy("n_nationkey").text(path)
    return io.read_bundles(s, path).groupBy("patient_id", "type").agg(F.count(F.lit(1)).alias("n"))


def _texts(s, d):
    """Uploads: orders of a customer as JSON lines, a JSON object of two lists, a JSON list or CSV."""
    o = r.table(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderstatus")
    g = o.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    lines = F.transform("x", lambda e: F.to_json(e))
    kind = F.col("id") % 4
    joined = F.array_join(lines, ", ")
    text = (
        F.when(kind == 0, F.array_join(lines, "\n\n"))
        .when(kind == 1, F.concat(F.lit('{"note": "x", "few": [{"y": "1"}], "rows": ['), joined, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit("["), joined, F.lit("]")))
        .otherwise(F.concat(F.lit("o_orderkey,o_orderstatus\n"), F.array_join(F.transform("x", lambda e: F.concat_ws(",", e["o_orderkey"].cast("string"), e["o_orderstatus"])), "\n")))
    )
    return g.select("id", text.alias("text"))


def decoded(s, d):
    got = stores.decode_texts(_texts(s, d))
    return got.groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.col("record")["o_orderkey"], F.col("record")["y"]).cast("long")).alias("least"))


def _store(s, d):
    """A store of every event as a document of its user, with a second version of each third."""
    e = r.run_log(s, d)
    body = F.to_json(F.struct(F.col("verdict").alias("verdict"), F.col("agent").alias("agent")))
    docs = e.select(F.concat(F.lit("w"), F.col("case_key") % 4).alias("workspace_id"), F.col("seq").alias("id"), F.col("seq").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("case_key").alias("fk"), "verdict", body.alias("body"))
    store = stores.Store(s, stores.shared_folder(s, "documents"), DOCUMENT)
    store.save(docs)
    store.save(docs.filter("id % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000_000).withColumn("created_at", F.lit("2030-01-01 00:00:00")).withColumn("verdict", F.lit("PASS")))
    return store


_DOCS = "docs as (select 'w' || case_key % 4 as workspace_id, seq as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, case_key as fk, case when seq % 3 = 0 then 'PASS' else verdict end as verdict, verdict as first, agent, cast(case when seq % 3 = 0 then 2 else 1 end as bigint) as version from run_log)"


class _Broken(CommittedStore):
    """A store whose saver is lost between the files and their entry."""

    def _before_commit(self) -> None:
        raise RuntimeError("lost")


def _committed(s, d):
    """Every user's first verdict; then the last one of each third user, whose saver is lost at first, and which comes twice; then each seventh is deleted."""
    first, last = (F.expr(f"{f}(verdict, seq)") for f in ("min_by", "max_by"))
    users = r.run_log(s, d).groupBy(F.col("case_key").alias("id")).agg(first.alias("first"), F.min("seq").alias("low"), last.alias("last"), F.max("seq").alias("high"))
    path, schema = stores.shared_folder(s, "committed"), "verdict string, seq long"
    store = CommittedStore(s, path, schema)
    store.save(users.select("id", F.col("first").alias("verdict"), F.col("low").alias("seq")), "open")
    third = users.filter("id % 3 = 0").select("id", F.col("last").alias("verdict"), F.col("high").alias("seq"))
    try:
        _Broken(s, path, schema).save(third, "close")
    except RuntimeError:
        pass
    store.save(third, "close")
    store.save(third, "close")
    store.delete(users.filter("id % 7 = 0").select("id"), "leave")
    return store


_USERS = """u as (select case_key as id, arg_min(verdict, seq) as first, min(seq) as low, arg_max(verdict, seq) as last, max(seq) as high from run_log group by case_key),
  b as (select id, '{"verdict":"' || first || '","seq":' || low || '}' as old, '{"verdict":"' || last || '","seq":' || high || '}' as new, case when id % 3 = 0 then last else first end as verdict, cast(case when id % 3 = 0 then 2 else 1 end as bigint) as version from u)"""


def point_reads(s, d):
    """The records of the first users of each remainder of 25, each read from the files that may hold it, and their number."""
    store = _committed(s, d)
    store.compact()
    keys = [x[0] for x in r.run_log(s, d).groupBy(F.col("case_key") % 25).agg(F.min("case_key").alias("k")).select("k").collect()]
    each = [store.get(k).select("id", "verdict", "version", F.lit(len(store.files_of(k))).alias("files")) for k in keys]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def reports(s, d):
    """Reports with the verdict that grounding gave, else the composed one."""
    e = r.run_log(s, d)
    body = F.to_json(F.struct(F.struct(F.when(F.col("seq") % 2 == 0, F.col("verdict")).alias("verdict")).alias("grounded"), F.struct(F.lit("WARN").alias("verdict")).alias("composite")))
    rows = e.select(F.lit("w").alias("workspace_id"), F.col("case_key").alias("id"), "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("seq").alias("fk"), F.coalesce(F.get_json_object(body, "$.grounded.verdict"), F.get_json_object(body, "$.composite.verdict")).alias("verdict"), body.alias("body"))
    store = stores.Store(s, stores.shared_folder(s, "reports"), DOCUMENT)
    store.save(rows)
    return store.current("w").select(F.col("id").alias("case_key"), F.col("seq").alias("run_id"), "verdict", "version")


def _signatures(s, d):
    return r.run_log(s, d).groupBy("agent").agg(F.max("signature").alias("current_signature"))


def _persisted(s, d):
    """Records persisted as files of their case's bucket, read back for each case."""
    path = stores.shared_folder(s, "records")
    log = r.run_log(s, d).groupBy("case_key").agg(F.max_by(F.struct("seq", "verdict"), "seq").alias("x")).select("case_key", "x.*")
    log.withColumn("bucket", F.col("case_key") % 8).write.mode("overwrite").partitionBy("bucket").json(path)
    return s.read.schema("case_key long, seq long, verdict string, bucket int").json(path).select("case_key", "seq", "verdict")


def evalpack(s, d):
    """A frozen pack: one canonical line for each agent with its outcomes counted, and its digest."""
    path = stores.shared_folder(s, "evalpack")
    n = r.run_log(s, d).groupBy("agent").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("BLOCK", "WARN", "PASS")], F.max("seq").alias("last"))
    n.select(stores.canonical_json(agent=F.col("agent"), block=F.col("BLOCK"), warn=F.col("WARN"), ok=F.col("PASS"), last=F.col("last")).alias("value")).write.text(path)
    back = s.read.schema("value string").text(path)
    return back.select(F.get_json_object("value", "$.agent").alias("agent"), F.get_json_object("value", "$.block").cast("long").alias("block"), F.sha2("value", 256).alias("digest"))


def registry(s, d):
    """Workspaces as keys with their tools and judges as JSON values; the latest value of a key holds."""
    keys = r.run_log(s, d).select(F.concat(F.lit("w"), F.col("case_key") % 4).alias("workspace_id"), F.col("agent"), "seq").groupBy("workspace_id", "agent").agg(F.max("seq").alias("seq"))
    rows = keys.select("workspace_id", F.xxhash64("agent").alias("id"), "seq", F.lit("2024").alias("created_at"), F.lit(0).cast("long").alias("fk"), F.col("agent").alias("verdict"), F.lit("{}").alias("body"))
    store = stores.Store(s, stores.shared_folder(s, "registry"), DOCUMENT)
    store.save(rows)
    store.save(rows.withColumn("seq", F.col("seq") + 1_000_000_000_000))
    return store.current().groupBy("workspace_id").agg(F.array_join(F.array_sort(F.collect_list("verdict")), ",").alias("tools"), F.min("version").alias("version"))


def pack_corpora(s, d):
    """All cases of the files of a pack, with the number from each file's folder."""
    path = stores.shared_folder(s, "packs")
    for part in range(2):
        _cases(s, d).filter(F.col("case_id").cast("long") % 2 == part).write.json(f"{path}/{part}")
    rows = io.read_packs(s, f"{path}/*")
    return rows.select(F.regexp_extract("file", r"/([0-9])/[^/]*$", 1).alias("part"), "case_id", "pack")


def foreign(s, d):
    rows = r.run_findings(s, d).groupBy(F.col("case_id").alias("id")).agg(F.collect_set("code").alias("flags"), F.max("vote").alias("verdict"))
    return stores.import_foreign(rows, r.dim_code(s).filter("tier < 3"))


def markdown(s, d):
    path = stores.shared_folder(s, "markdown")
    n = r.table(s, d, "nation")
    lines = n.select(F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |")).alias("value"))
    head = s.createDataFrame([("# Nations",), ("| key | name |",), ("|---|:-:|",), ("",)], "value string")
    head.unionByName(lines).write.text(path)
    return io.markdown_rows(s.read.schema("value string").text(path), ["key", "name"])


QUERIES = {
    "s01_pack_scan": (pack_scan, sql(f"select cast(case_id as varchar) as case_id, source as pack, lang as agent_type, {_VERDICT} as expected, not gold_block as clean_negative from cases", "cases")),
    "s02_run_scan": (run_scan, sql(f"select cast(case_id as varchar) as case_id, pack, run as run_index, verdict from ({_RUNS})", "votes")),
    "s03_run_sink": (run_sink, sql(f"select pack, verdict, count(*) as n from ({_RUNS}) group by pack, verdict", "votes")),
    "s04_case_sink": (
        case_sink,
        sql("""select cast(case_id as varchar) as case_id, sha256('{"case_id": "' || case_id || '", "lang": "' || lang || '", "source": "' || source || '", "verdict": ' || case when gold_block then '"reject"' else 'null' end || '}') as sha256 from cases""", "cases"),
    ),
    "s05_correction_log": (correction_log, sql("with f as (select distinct case_id, code from run_findings where gradeable) select action, code as flag_code, count(*) as n, cast(0 as bigint) as before from f, (values ('suppress'), ('inject')) a(action) group by action, code", "run_findings")),
    "s07_corpus_split": (
        corpus_split,
        sql("with f as (select distinct case_id, code from run_findings where gradeable) select code as flag_code, count(*) as n from f where cast('0x' || substr(sha1('split|' || case_id), 1, 8) as bigint) % 100 < 30 group by code", "run_findings"),
    ),
    "s08_cohort_csv": (cohort_csv, "select cast(c_custkey as varchar) as c_custkey, c_name, case when c_custkey % 5 > 0 then c_mktsegment else '' end as c_mktsegment from customer"),
    "s09_bundles": (bundles, "select 'n' || n_nationkey as patient_id, 'Patient' as type, cast(1 as bigint) as n from nation union all select 'n' || c_nationkey, 'Condition', count(*) from customer group by c_nationkey"),
    "s10_decode": (
        decoded,
        """with g as (select o_custkey as id, count(*) as n, min(o_orderkey) as least from orders group by o_custkey)
            select id, case id % 4 when 0 then case when n = 1 then 'json' else 'jsonl' end when 3 then 'csv' else 'json' end as kind, n, case when id % 4 = 1 and n = 1 then 1 else least end as least from g""",
    ),
    "s13_store_upsert": (lambda s, d: _store(s, d).current().select("workspace_id", "id", "verdict", "created_at", "version"), sql(f"with {_DOCS} select workspace_id, id, verdict, created_at, version from docs", "run_log")),
    "s14_by_key": (
        lambda s, d: _store(s, d).by_key("fk", r.table(s, d, "customer").select(F.col("c_custkey").alias("fk"))).select("fk", "id", "verdict"),
        sql(f"with {_DOCS} select fk, id, verdict from docs where fk in (select c_custkey from customer)", "run_log"),
    ),
    "l07_committed_audit": (
        lambda s, d: _committed(s, d).audit().select("id", "save", "action", "before", "after"),
        sql(
            f"""with {_USERS} select id, 'open' as save, 'create' as action, null as before, old as after from b union all select id, 'close', 'update', old, new from b where id % 3 = 0
            union all select id, 'leave', 'delete', case when id % 3 = 0 then new else old end, null from b where id % 7 = 0""",
            "run_log",
        ),
    ),
    "s13_committed_upsert": (lambda s, d: _committed(s, d).current().select("id", "verdict", "version"), sql(f"with {_USERS} select id, verdict, version from b where id % 7 > 0", "run_log")),
    "s14_point_reads": (
        point_reads,
        sql(f"with {_USERS} select id, verdict, version, 1 as files from b where id in (select min(case_key) from run_log group by case_key % 25) and id % 7 > 0", "run_log"),
    ),
    "s15_json_fields": (
        lambda s, d: io.find_by_json(_store(s, d).current("w1"), "body", {"verdict": "BLOCK", "agent": "click"}).select("id", "created_at"),
        sql(f"with {_DOCS} select id, created_at from docs where workspace_id = 'w1' and first = 'BLOCK' and agent = 'click'", "run_log"),
    ),
    "s16_case_store": (
        lambda s, d: _store(s, d).listed(100).select("workspace_id", "id", "created_at"),
        sql(f"with {_DOCS} select workspace_id, id, created_at from docs order by created_at desc, id desc limit 100", "run_log"),
    ),
    "s17_report_store": (reports, sql("select case_key, max(seq) as run_id, case when max(seq) % 2 = 0 then arg_max(verdict, seq) else 'WARN' end as verdict, count(*) as version from run_log group by case_key", "run_log")),
    "s18_provenance": (
        lambda s, d: stores.Provenance(r.run_log(s, d)).fresh(_signatures(s, d)).select("agent", "case_key", "seq", "verdict", "fresh"),
        sql(
            """with h as (select agent, case_key, max(seq) as seq, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature from run_log where replay_of is null group by agent, case_key), c as (select agent, max(signature) as now from run_log group by agent)
            select h.agent, case_key, seq, verdict, signature = now as fresh from h join c on h.agent = c.agent""",
            "run_log",
        ),
    ),
    "l03_replay_restamp": (
        lambda s, d: stores.Provenance(r.run_log(s, d)).restamped(_signatures(s, d)),
        sql(
            """with h as (select agent, case_key, max(seq) as seq, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature from run_log where replay_of is null group by agent, case_key), c as (select agent, max(signature) as now from run_log group by agent)
            select h.agent, case_key, verdict, 'run-' || seq as replay_of, 'replay-' || sha1('replay|' || seq) as run_id from h join c on h.agent = c.agent where signature = now""",
            "run_log",
        ),
    ),
    "s19_persisted_records": (_persisted, sql("select case_key, max(seq) as seq, arg_max(verdict, seq) as verdict from run_log group by case_key", "run_log")),
    "s20_evalpack": (
        evalpack,
        sql(
            """with n as (select agent, count(*) filter (verdict = 'BLOCK') as b, count(*) filter (verdict = 'WARN') as w, count(*) filter (verdict = 'PASS') as p, max(seq) as m from run_log group by agent)
            select agent, b as block, sha256('{"agent": "' || agent || '", "block": "' || b || '", "last": "' || m || '", "ok": "' || p || '", "warn": "' || w || '"}') as digest from n""",
            "run_log",
        ),
    ),
    "s21_registry": (registry, sql("select 'w' || case_key % 4 as workspace_id, string_agg(distinct agent, ',' order by agent) as tools, cast(2 as bigint) as version from run_log group by 1", "run_log")),
    "s22_pack_corpora": (pack_corpora, sql("select cast(case_id % 2 as varchar) as part, cast(case_id as varchar) as case_id, source as pack from cases", "cases")),
    "s23_foreign_import": (
        foreign,
        sql(
            """select case_id as id, max(vote) as verdict, coalesce(string_agg(distinct code, ',' order by code) filter (tier < 3), '') as flags, coalesce(string_agg(distinct code, ',' order by code) filter (tier = 3), '') as quarantined,
            count(*) filter (tier = 3) = 0 as accepted from run_findings group by case_id""",
            "run_findings",
        ),
    ),
    "s27_markdown": (markdown, "select cast(n_nationkey as varchar) as key, n_name as name from nation"),
}
