"""Structured Streaming versions of the time-based views. Event time is a timestamp in UTC; late rows fall to the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.shared import exists


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = 64) -> DataFrame:
    """A Parquet folder (or file pattern) as a stream with ``ts`` as event time; with None all present files are one batch, so none of their events is late."""
    source = spark.readStream.schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and value sums of each type and window; works on batches and streams alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", delay: str = "1 hour") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def drift_alerts(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Stream-static join: rows whose verdict differs from the frozen baseline's, or that it lacks."""
    j = current.join(baseline.select(key, F.col("verdict").alias("baseline")), key, "left")
    return j.withColumn("baseline", F.coalesce("baseline", F.lit("ABSENT"))).filter(F.col("verdict") != F.col("baseline"))


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = 64):
    """Keeps each key's latest row. Keys are dealt over buckets; a batch writes new versions of the buckets that it touches, then their numbers.

    A batch reads only versions below its own number, so one that is run again after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = lambda rows: rows.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows = placed(batch)
        touched = [r[0] for r in rows.select("key_bucket").distinct().collect()]  # at most ``buckets``
        known = _versions(spark, path, number)
        old = [f"{path}/version={known[b]}/key_bucket={b}" for b in touched if b in known]
        if old:
            rows = rows.unionByName(placed(spark.read.schema(batch.schema).parquet(*old)))
        others = [c for c in batch.columns if c not in (key, order)]
        latest = rows.groupBy(key, "key_bucket").agg(F.max_by(F.struct(*others, order), order).alias("x")).select(key, "x.*", "key_bucket")
        latest.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{path}/version={number}")
        if touched:
            spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("append").parquet(f"{path}_versions")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The last version of each bucket that was finished, below a number if one is given: at most as many as buckets."""
    if not exists(spark, f"{path}_versions"):
        return {}
    written = spark.read.schema("bucket int, version long").parquet(f"{path}_versions")
    rows = written if below is None else written.filter(F.col("version") < below)
    return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("version").alias("v")).collect()}


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of every bucket, or None before the first."""
    known = _versions(spark, path)
    return spark.read.parquet(*[f"{path}/version={v}/key_bucket={b}" for b, v in sorted(known.items())]) if known else None


def settled(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its complete result, read back from Parquet in ``folder``.

    State, progress and results stand below the folder, which driver and executors must share; no row passes the driver.
    A batch that is run again writes the same place.
    """
    done = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
        done.append(number)

    query = df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(f"{folder}/result/batch={done[-1]}") if done else spark.createDataFrame([], df.schema)


def appended(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream without aggregations over all that is there now, appending its rows to Parquet in ``folder``, and reads them."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/result").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/result")


BREAKS = "case_key long, seq long, before string, signature string"


def break_step(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: compares a batch (case_key, seq, signature) with the last row of each key, which it then replaces.

    The last row of each key is a table of its own, one version a batch; a batch is compared in a window that spills, so
    no key's rows have to fit in memory. A row that is no newer than its key's last one is no break. A batch that is run
    again reads the version before it and writes the same places.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("case_key", "seq", "signature", F.lit(True).alias("new"))
        if number:
            known = spark.read.parquet(f"{folder}/last/batch={number - 1}")
            rows = rows.unionByName(known.select("case_key", "seq", "signature", F.lit(False).alias("new")))
        order = "partition by case_key order by seq, new desc"  # at equal seq what is known comes last, where the next row sees it
        rows = rows.withColumn("before", F.expr(f"lag(signature) over ({order})"))
        rows = rows.withColumn("seen", F.expr(f"max(case when not new then seq end) over ({order} rows between unbounded preceding and unbounded following)"))
        rows.persist()  # else the stream's own state is read twice
        found = rows.filter("new and not signature <=> before and (seen is null or seq > seen)")
        found.select("case_key", "seq", "before", "signature").write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
        last = rows.groupBy("case_key").agg(F.max_by(F.struct("seq", "signature"), F.struct("seq", ~F.col("new"))).alias("x")).select("case_key", "x.*")
        last.write.mode("overwrite").parquet(f"{folder}/last/batch={number}")
        rows.unpersist()

    return step


def breaks(log: DataFrame, folder: str) -> DataFrame:
    """Rows of a stream (case_key, seq, signature) whose signature differs from the one before, with that one (null at the first).

    Runs over all that has arrived since the run before with the same ``folder`` (``break_step``) and returns the rows of all runs.
    """
    log.writeStream.foreachBatch(break_step(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.sparkSession.read.schema(BREAKS).parquet(f"{folder}/result/batch=*")
