"""Streams over several triggers: state is carried from one run to the next, late rows fall to the watermark, repeated rows are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assaylake.shared import conf
from assaylake.streaming import views

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Run:
    """Of a stream: what was appended in all triggers, and its checkpoint, in which the open state stands."""

    spark: SparkSession
    folder: str
    schema: object

    @property
    def appended(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/result")

    @property
    def state(self) -> DataFrame:
        """key, value of the last stateful operator after the last trigger."""
        return self.spark.read.format("statestore").load(f"{self.folder}/checkpoint")


def arriving(arrivals: list[DataFrame], folder: str) -> Iterator[DataFrame]:
    """The file stream of what has come so far, once for each of the arrivals, after that has come."""
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    arrivals[0].limit(0).write.parquet(f"{folder}/in")
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(schema).parquet(f"{folder}/in")


def triggered(arrivals: list[DataFrame], view: Callable[[DataFrame], DataFrame], folder: str) -> Run:
    """Runs ``view`` over a file stream once for each of the arrivals, as a scheduled job does, appending its rows to Parquet.

    Each run reads what has arrived since the one before and ends with a batch that closes what the watermark has passed, so
    a row is late if its window ends by the latest event time of earlier arrivals less the delay. Arrivals, results, state and
    progress stand below the folder, which driver and executors must share.
    """
    out = None
    for stream in arriving(arrivals, folder):
        out = view(stream)
        query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/result")
        query.trigger(availableNow=True).start().awaitTermination()
    return Run(arrivals[0].sparkSession, folder, out.schema)


def breaks_once(arrivals: list[DataFrame], folder: str, delay: str = "2 days") -> DataFrame:
    """``views.breaks`` of the arrivals (case_key, seq, signature, ts), each run as a job of its own, without rows that repeat a seq within ``delay``.

    The seqs of the last ``delay`` are state of the stream, in RocksDB under ``conf(..., ROCKS)``; the last row of each key is a
    table. No row goes through Python, unlike in ``signature_breaks``, whose calls cost about 7 ms a key and trigger.
    """
    out = None
    for stream in arriving(arrivals, folder):
        out = views.breaks(once(stream, "seq", delay), folder)
    return out


def late_count(run: Run, rows: int, n: str, open_n: str) -> DataFrame:
    """arrived, emitted, open, late: what became of the rows, by the counts ``n`` of emitted windows and ``open_n`` of those in the state."""
    emitted = run.appended.agg(F.coalesce(F.sum(n), F.lit(0)).alias("emitted"))
    still = run.state.agg(F.coalesce(F.sum(open_n), F.lit(0)).alias("open"))
    one = emitted.crossJoin(F.broadcast(still)).withColumn("arrived", F.lit(rows).cast("long"))  # a row each
    return one.select("arrived", F.col("emitted").cast("long").alias("emitted"), F.col("open").cast("long").alias("open"), (F.col("arrived") - F.col("emitted") - F.col("open")).cast("long").alias("late"))


def once(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows of a stream without those that repeat a key within ``delay`` of event time; state older than that is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


class Breaks(StatefulProcessor):
    """Keeps the last seq and signature of each key, and forgets a key when the watermark is ``idle_ms`` past its last event."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, signature string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seq, before = self.last.get() if self.last.exists() else (None, None)
        newest = 0
        for r in sorted(rows, key=lambda r: r.seq):  # those of one key in one trigger
            if seq is not None and r.seq <= seq:  # older than what was seen
                continue
            if r.signature != before:
                yield Row(case_key=key[0], seq=r.seq, before=before, signature=r.signature)
            seq, before = r.seq, r.signature
            newest = max(newest, int(r.ts.timestamp() * 1000))
        if seq is not None:
            self.last.update((seq, before))
        if self.idle_ms is not None and newest:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def signature_breaks(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Rows of a stream (case_key, seq, signature, ts) whose signature differs from their key's one before (null at the first).

    State is one value a key, in RocksDB (``conf(spark, spark__sql__streaming__stateStore__providerClass=ROCKS)``), so it does
    not have to fit in memory; the rows of one key in one trigger do. Rows of a key have to arrive in the order of seq, as far
    as triggers go: an older one is no break. With ``idle_ms`` a key that rests so long starts anew.
    """
    out = "case_key long, seq long, before string, signature string"
    from pyspark.sql.types import StructType

    return log.groupBy("case_key").transformWithState(Breaks(idle_ms), StructType.fromDDL(out), "append", "none" if idle_ms is None else "eventTime")
