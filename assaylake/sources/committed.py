"""Records and their audit rows in one commit, with point reads.

A save writes new files of records and of audit rows, which nobody reads yet, and then one manifest entry that names both:
``manifest/<number>.json``. An entry is made by a rename that fails where the number is taken, so of two savers one wins
and the other begins again on what the first has saved. What no entry names does not exist; a save that fails before its
entry has changed nothing, and one that comes again under its name is known by it and changes nothing either.

Records are dealt over buckets by a hash of their id and ordered by it within files. The entry has each file's bucket and
range of ids, so a read of one record opens the files that may hold it. ``compact`` writes every bucket anew with all
versions, in order, and an entry that replaces those before it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.shared import exists

AUDIT = "id long, save string, number long, action string, before string, after string"


class Conflict(Exception):
    """Another save has taken the number."""


@dataclass
class State:
    """The entries that hold, in their order: number of the last, files of records (bucket, low, high, path), files of audit rows, names of saves."""

    number: int = 0
    records: list[dict] = field(default_factory=list)
    audit: list[str] = field(default_factory=list)
    saves: set[str] = field(default_factory=set)


class CommittedStore:
    """Versioned records (``id`` and the columns of ``schema``) with an audit row for each that a save touches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), f"id long, {schema}", buckets
        self.stored = f"{self.schema}, deleted boolean, number long"

    # the manifest

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(conf)
        return fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(place).toUri(), conf), jvm.org.apache.hadoop.fs.Path

    def state(self) -> State:
        """What the entries say. There is one for each save since the last compaction, and they are small."""
        out = State()
        if not exists(self.spark, f"{self.path}/manifest"):
            return out
        entries = self.spark.read.text(f"{self.path}/manifest/*.json", wholetext=True).collect()
        for e in sorted((json.loads(r["value"]) for r in entries), key=lambda e: e["number"]):
            if e["replaces"]:
                out.records, out.audit = [], []
            out.number = e["number"]
            out.records += e["records"]
            out.audit += e["audit"]
            out.saves |= set(e["saves"])
        return out

    def _commit(self, after: State, entry: dict) -> None:
        """Makes the entry after that state, or raises Conflict where another one is there."""
        fs, context, path = self._fs()
        name = f"{self.path}/manifest/{after.number + 1:012d}.json"
        draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(path(f"{self.path}/manifest"))
        out = fs.create(draft)
        out.write(json.dumps({"number": after.number + 1} | entry).encode())
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, path(name), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            raise Conflict(name) from None

    # writes

    def _bucket(self, id_):
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame) -> list[dict]:
        """Files of the rows, each of one bucket and in order of id. A large bucket is several files, also of one id."""
        folder = f"{self.path}/records/{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket(F.col("id")))
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id", "number").write.partitionBy("bucket").parquet(folder)
        files = self.spark.read.schema(f"{self.stored}, bucket int").parquet(folder).groupBy("bucket", F.col("_metadata.file_path").alias("path")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
        return [r.asDict() for r in files.collect()]

    def _attempt(self, rows: DataFrame, save: str, deletes: bool) -> None:
        before = self.state()
        if save in before.saves:
            return
        now = self._at(before)
        body = F.struct(*self._columns())
        old = now.select(F.col("id").alias("_known"), body.alias("_old"))
        new = rows.select("id", body.alias("_new")) if not deletes else rows.select("id", F.lit(None).alias("_new"))
        both = new.join(old, F.col("id") == F.col("_known"), "left")
        touched = both.filter("_known is not null") if deletes else both  # what is not there is not deleted
        action = F.lit("delete") if deletes else F.when(F.col("_known").isNull(), "create").otherwise("update")
        text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
        after = F.lit(None).cast("string") if deletes else text("_new")
        number = F.lit(before.number + 1).cast("long").alias("number")
        folder = f"{self.path}/audit/{uuid.uuid4().hex}"
        touched.select("id", F.lit(save).alias("save"), number, action.alias("action"), text("_old").alias("before"), after.alias("after")).write.parquet(folder)
        held = "_old" if deletes else "_new"  # a deleted record keeps what it was
        records = touched.select("id", *[F.col(f"{held}.{c}").alias(c) for c in self._columns()], F.lit(deletes).alias("deleted"), number)
        files = self._written(records)
        self._before_commit()
        self._commit(before, {"replaces": False, "records": files, "audit": [folder], "saves": [save]})

    def _before_commit(self) -> None:
        """Between the files and their entry; tests let it fail."""

    def save(self, rows: DataFrame, save: str | None = None, attempts: int = 5, deletes: bool = False) -> str:
        """Creates or updates the rows' records and writes their audit rows, both or neither. Rows that repeat an id are one, the largest.

        ``save`` names the save; one that comes again under the name of one that is done changes nothing."""
        save = save or uuid.uuid4().hex
        columns = [] if deletes else self._columns()
        whole = F.max(F.struct(*columns) if columns else F.lit(0)).alias("x")
        single = rows.filter("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(whole).select("id", *[F.col(f"x.{c}") for c in columns])
        for k in range(attempts):
            try:
                self._attempt(single, save, deletes)
                return save
            except Conflict:
                if k + 1 == attempts:
                    raise
        return save

    def delete(self, ids: DataFrame, save: str | None = None) -> str:
        """Deletes the records of the ids; those that are not there leave no trace."""
        return self.save(ids, save, deletes=True)

    def compact(self) -> None:
        """All versions in as few files as there are buckets, and one entry that replaces those before; reads say the same."""
        now = self.state()
        if now.records:
            files = self._written(self._read(now.records))
            self._commit(now, {"replaces": True, "records": files, "audit": now.audit, "saves": sorted(now.saves)})

    # reads

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema][1:]

    def _read(self, files: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*[f["path"] for f in files]) if files else self.spark.createDataFrame([], self.stored)

    def _latest(self, versions: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self._columns(), "deleted"), "number").alias("x")
        saves = F.count(F.lit(1)).alias("version")  # a save has one row a record
        return versions.groupBy("id").agg(last, saves).filter("not x.deleted").select("id", *[F.col(f"x.{c}") for c in self._columns()], "version")

    def _at(self, state: State) -> DataFrame:
        return self._latest(self._read(state.records))

    def current(self) -> DataFrame:
        """id, the columns and ``version``, the number of saves that touched the record."""
        return self._at(self.state())

    def files_of(self, id_: int) -> list[dict]:
        """The files that may hold a record: of its bucket, and with its id in their range."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(id_).cast("long"))).first()[0]
        return [f for f in self.state().records if f["bucket"] == bucket and f["low"] <= id_ <= f["high"]]

    def get(self, id_: int) -> DataFrame:
        """One record, read from the files that may hold it."""
        return self._latest(self._read(self.files_of(id_)).filter(F.col("id") == id_))

    def audit(self) -> DataFrame:
        """id, save, number, action (create, update, delete), before and after (JSON) of everything saved."""
        folders = self.state().audit
        return self.spark.read.schema(AUDIT).parquet(*folders) if folders else self.spark.createDataFrame([], AUDIT)
