"""Stores of versioned records: append-only Parquet logs, partitioned by workspace, of which the latest row of each key counts.

A save appends rows with an ascending ``seq``; nothing is rewritten, so a save that is run again after a failure adds rows
that the reads fold: rows of one key and ``seq`` are one version. Reads are aggregations over the log, and a filter on the
workspace reads its files alone. Stores whose saves come with audit rows, and that are read by key, are in ``committed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators.history import latest, latest_authoritative
from assaylake.shared import shared_folder


class Store:
    """Records with workspace_id, id, seq, created_at and a JSON body."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("workspace_id").parquet(self.path)

    def log(self, workspace: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if workspace is None else rows.filter(F.col("workspace_id") == workspace)

    def current(self, workspace: str | None = None) -> DataFrame:
        """Each record's latest row with the time of its first, and the number of its versions."""
        log = self.log(workspace)
        log = log.groupBy("workspace_id", "id", "seq").agg(*[F.max_by(c, F.struct("created_at", "body")).alias(c) for c in log.columns if c not in ("workspace_id", "id", "seq")])
        others = [c for c in log.columns if c not in ("workspace_id", "id", "seq", "created_at")]
        head = F.max_by(F.struct(*others, "seq"), "seq").alias("head")
        return log.groupBy("workspace_id", "id").agg(head, F.min_by("created_at", "seq").alias("created_at"), F.count(F.lit(1)).alias("version")).select("workspace_id", "id", "head.*", "created_at", "version")

    def get(self, key: Column) -> DataFrame:
        return self.current().filter(F.col("id") == key)

    def by_key(self, column: str, values: DataFrame) -> DataFrame:
        """The current records whose ``column`` is among the values."""
        return self.current().join(values, column, "left_semi")

    def listed(self, limit: int, newest_first: bool = True) -> DataFrame:
        order = [F.desc("created_at"), F.desc("id")] if newest_first else ["created_at", "id"]
        return self.current().orderBy(*order).limit(limit)


class Provenance:
    """Runs of agents over cases: heads, authoritative heads, versions and a run's own history."""

    def __init__(self, runs: DataFrame):
        self.runs = runs

    def latest_for(self) -> DataFrame:
        return latest(self.runs, ["agent", "case_key"], "seq", ["verdict", "signature"])

    def authoritative(self) -> DataFrame:
        return latest_authoritative(self.runs, ["agent", "case_key"], "seq", ["verdict", "signature"])

    def fresh(self, signatures: DataFrame) -> DataFrame:
        """Authoritative heads whose signature is the agent's current one; an absent signature is never fresh."""
        j = self.authoritative().join(signatures, "agent", "left")
        return j.withColumn("fresh", F.coalesce(F.col("signature").isNotNull() & (F.col("signature") == F.col("current_signature")), F.lit(False)))

    def restamped(self, signatures: DataFrame) -> DataFrame:
        """A replay of each fresh head: an id of its own that points at the authoritative run, never at a replay."""
        head = self.fresh(signatures).filter("fresh")
        return head.select("agent", "case_key", "verdict", F.concat(F.lit("run-"), F.col("seq").cast("string")).alias("replay_of"), F.concat(F.lit("replay-"), F.sha1(F.concat_ws("|", F.lit("replay"), F.col("seq").cast("string")))).alias("run_id"))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, and ``", "`` and ``": "`` between them; null is null, and strings are quoted as JSON."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("x"))), r'^\{"x":(.*)\}$', 1)
    parts = [F.concat(F.lit(f'"{k}": '), F.when(v.isNull(), F.lit("null")).otherwise(quoted(v))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def decode_texts(texts: DataFrame) -> DataFrame:
    """id, kind, place, record (a map of strings) of uploaded texts (id, text).

    A text that starts with a bracket is JSON, one whose lines are objects JSON lines. In a JSON object the longest list
    of records counts, the first on ties; an object without any is one record. ``place`` is -1 and ``record`` null for a
    text or line that is no JSON.
    """
    t, many, one = F.trim("text"), "array<map<string,string>>", "map<string,string>"
    entries = F.transform(F.map_entries(F.from_json(t, one)), lambda e: F.from_json(e["value"], many))
    lists = F.filter(entries, lambda r: r.isNotNull() & (F.size(r) > 0))
    longest = F.reduce(lists, F.slice(F.from_json(F.lit("[{}]"), many), 1, 0), lambda a, r: F.when(F.size(r) > F.size(a), r).otherwise(a))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    kind = F.when(t.startswith("["), "json").when(F.from_json(t, one).isNotNull() & (F.size(lines) == 1), "json").when(F.get(lines, F.lit(0)).startswith("{"), "jsonl").otherwise("csv")
    names = F.split(F.get(lines, F.lit(0)), ",")
    rows = F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.map_from_arrays(names, F.slice(F.split(x, ",", -1), F.lit(1), F.size(names))))
    records = F.when(F.col("kind") == "jsonl", F.transform(lines, lambda x: F.from_json(x, one))).when(F.col("kind") == "csv", rows).when(t.startswith("["), F.from_json(t, many)).when(F.size(lists) > 0, longest).otherwise(F.array(F.from_json(t, one)))
    out = texts.withColumn("kind", kind).select("id", "kind", F.posexplode_outer(records).alias("place", "record"))
    return out.select("id", "kind", F.when(F.col("record").isNull(), -1).otherwise(F.col("place")).alias("place"), "record")


def import_foreign(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Foreign rows (id, verdict, flags) as cases: known flags stay, unknown ones are quarantined, and such a case is held back."""
    known = codes.agg(F.collect_set("code").alias("known"))
    j = rows.crossJoin(F.broadcast(known)).withColumn("unknown", F.array_except("flags", "known"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return j.select("id", "verdict", text(F.array_intersect("flags", "known")).alias("flags"), text("unknown").alias("quarantined"), (F.size("unknown") == 0).alias("accepted"))
