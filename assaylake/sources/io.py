"""Sources and sinks of evaluation records: JSON lines, CSV cohorts, bundles, sniffed uploads, versioned document tables."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.shared import Scratch, exists, join_dealt


def read_ndjson(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. Strict fails on a malformed line, else it is in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that may not exist yet: no rows then."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_corpus(rows: DataFrame, path: str) -> None:
    """Partitioned by split, so a filter on split reads its files alone."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.CORRECTION).json(path)
    return rows.filter(F.col("split") == split) if split else rows


def write_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("pack").parquet(path)


def read_packs(spark: SparkSession, pattern: str, limit: int | None = None) -> DataFrame:
    """All cases of a pack's files with the file each came from; the limit is the caller's."""
    rows = spark.read.schema(schemas.CASE).json(pattern).withColumn("file", F.input_file_name())
    return rows.orderBy("file", "case_id").limit(limit) if limit else rows


def read_cohort_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty field stays an empty string."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


#: What stands before each entry's resource in a bundle; within a string its quotes would be escaped.
ENTRY = '"resource"'


def _whole_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, at, resource of files that are read as a row each."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "struct<entry: array<struct<resource: string>>>").alias("b"))
    return files.select("file", F.posexplode("b.entry.resource").alias("at", "resource")).select("file", F.struct(F.lit(0).cast("long").alias("block"), F.col("at").cast("long").alias("row")).alias("at"), "resource")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row a resource of each bundle file: patient_id of the file's first Patient, resource type, resource as JSON text.

    A file is cut where an entry's resource begins, so it is read in splits by many tasks and no bundle is ever a row. A file
    in which that key stands elsewhere too, within a resource or as a value, has a piece that is no whole object; such
    files are read again as a row each. A file's entries are joined with its patient, large files dealt over shares.
    """
    scratch = Scratch(spark, "bundles")
    pieces = spark.read.option("lineSep", ENTRY).text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value")
    first = (F.col("at.block") == 0) & F.ltrim("value").startswith("{")  # what stands before the first entry
    body = F.regexp_extract("value", r"(?s)^\s*:\s*(\{.*)", 1)
    cut = scratch.written(pieces.filter(~first).select("file", "at", F.get_json_object(body, "$").alias("resource")))
    odd = [r["file"] for r in cut.filter("resource is null").select("file").distinct().collect()]  # names of files
    entries = cut
    if odd:
        marked = spark.createDataFrame([(f,) for f in odd], "file string")
        entries = scratch.written(cut.join(marked, "file", "left_anti").unionByName(_whole_bundles(spark, odd)))
    kind = F.get_json_object("resource", "$.resourceType")
    typed = entries.select("file", "at", kind.alias("type"), "resource")
    patient = F.min_by(F.get_json_object("resource", "$.id"), F.when(F.col("type") == "Patient", F.col("at"))).alias("patient_id")
    files = typed.groupBy("file").agg(patient, F.count(F.lit(1)).alias("k"))
    return scratch.result(join_dealt(typed, files, "file", "k", typed.count()).select("patient_id", "type", "resource"))


def sniff_format(text: str, filename: str = "") -> str:
    """json, jsonl or csv: by the file's ending, else by its first characters."""
    for ending, kind in ((".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"), (".csv", "csv")):
        if filename.lower().endswith(ending):
            return kind
    head = text.lstrip()
    if head[:1] in "[{" and head:
        try:
            json.loads(text)
            return "json"
        except ValueError:
            return "jsonl"
    return "csv"


def decode_upload(spark: SparkSession, text: str, filename: str = "") -> DataFrame:
    """Records of one uploaded text (it is in the driver's hands already) as rows of strings.

    In a JSON object the longest list of records counts, the first on ties. A line that is no JSON is an error with its
    number, and so is a CSV with a header alone.
    """
    kind = sniff_format(text, filename)
    if kind == "json":
        got = json.loads(text)
        lists = [(k, v) for k, v in got.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)] if isinstance(got, dict) else []
        records = got if isinstance(got, list) else max(lists, key=lambda kv: len(kv[1]))[1] if lists else [got]
    elif kind == "jsonl":
        records = []
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    records.append(json.loads(line))
                except ValueError as e:
                    raise ValueError(f"line {n}: {e}") from e
    else:
        records = list(csv.DictReader(io.StringIO(text)))
        if not records:
            raise ValueError("no rows below the header")
    names = list(dict.fromkeys(k for r in records for k in r))
    value = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, sort_keys=True)
    return spark.createDataFrame([tuple(value(r.get(n)) for n in names) for r in records], ", ".join(f"`{n}` string" for n in names))


def upsert(current: DataFrame | None, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after the changes: of each key the row of the largest ``order``, with the first row's created_at."""
    rows = changes if current is None else current.unionByName(changes)
    others = [c for c in rows.columns if c not in (*key, order, "created_at")]
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*others, order), order).alias("x"), F.min_by("created_at", order).alias("created_at"))
    return g.select(*key, "x.*", "created_at")


def find_by_json(rows: DataFrame, body: str, fields: dict[str, str]) -> DataFrame:
    """Rows whose JSON body holds all given values at the top level."""
    for k, v in fields.items():
        rows = rows.filter(F.get_json_object(body, f"$.{k}") == v)
    return rows


def list_documents(rows: DataFrame, limit: int, newest_first: bool = True) -> DataFrame:
    """Filter first, then order by created_at and id, then limit."""
    order = [F.desc("created_at"), F.desc("id")] if newest_first else ["created_at", "id"]
    return rows.orderBy(*order).limit(limit)


def expected_verdicts(value: Column) -> Column:
    """A verdict given as one string or as a JSON list becomes an array; null becomes an empty one."""
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.startswith(F.trim(value), F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))


def markdown_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of pipe tables in a column ``value`` of text lines; rules and the header (equal to ``columns``) are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.trim("value").startswith("|")).select(cells.alias("c")).filter(F.size("c") == len(columns))
    rows = rows.filter(~F.forall("c", lambda x: x.rlike("^:?-+:?$"))).filter(F.array_join("c", "|") != "|".join(columns))
    return rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def fenced_json(text: Column, schema: str) -> Column:
    """The first JSON object of a reply that may stand in a code fence with words around it; null where none parses."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(inner != "", inner).otherwise(bare), schema)
