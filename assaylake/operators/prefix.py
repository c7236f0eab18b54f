"""Numbering and runs in the order of a key's rows, where one key may hold most of them.

Rows are dealt over ranges of (key, order), so a hot key's rows lie in as many ranges as they fill. What a running count
needs of the rows before a range is summed up in one row for each key and range, and only these summaries go through a
window of a whole key: as many rows as there are ranges. Within a range numbers are counted by themselves, and the
summaries are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.shared import Scratch

RANGE, AT = "_range", "_at"


def _ranged(scratch: Scratch, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range and their place in it; written, so that both are read again as they are."""
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorts = [F.col(c) for c in (*keys, *order)]
    dealt = log.repartitionByRange(parts, *sorts).sortWithinPartitions(*sorts).withColumn(AT, F.monotonically_increasing_id())
    return scratch.written(dealt.withColumn(RANGE, F.shiftright(AT, 33)))


def _with(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary of their key and range; null keys are keys too."""
    s = summary.withColumnsRenamed({c: f"_s_{c}" for c in (*keys, RANGE)})
    same = F.col(RANGE) == F.col(f"_s_{RANGE}")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return rows.join(s, same).drop(*[f"_s_{c}" for c in (*keys, RANGE)])


def _numbered(scratch: Scratch, log: DataFrame, keys: list[str], order: list[str], facts: dict | None = None) -> DataFrame:
    """Rows with ``_row``, from 1 in their key, ``_all``, the key's rows, and each of the ``facts`` (aggregates) of the key's first range."""
    rows = _ranged(scratch, log, keys, order)
    part = ", ".join(keys)
    facts = facts or {}
    summary = rows.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_n"), F.min(AT).alias("_first"), *[f.alias(n) for n, f in facts.items()])
    before = F.expr(f"sum(_n) over (partition by {part} order by {RANGE}) - _n").alias("_before")
    total = F.expr(f"sum(_n) over (partition by {part})").alias("_all")
    firsts = [F.expr(f"first_value({n}) over (partition by {part} order by {RANGE})").alias(n) for n in facts]
    known = summary.select(*keys, RANGE, "_first", before, total, *firsts)
    return _with(rows, known, keys).withColumn("_row", F.col(AT) - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def versions(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """1-based version numbers in order; the last is current, the others superseded."""
    scratch = Scratch(log.sparkSession, "versions")
    rows = _numbered(scratch, log, keys, [order])
    state = F.when(F.col("_row") == F.col("_all"), "current").otherwise("superseded")
    return scratch.result(rows.select(*log.columns, F.col("_row").alias("version"), state.alias("state")))


def first_created(log: DataFrame, keys: list[str], order: str, ts: str = "ts") -> DataFrame:
    """History sequence of each write and the time of the key's first."""
    scratch = Scratch(log.sparkSession, "created")
    rows = _numbered(scratch, log, keys, [order], {"created_at": F.min_by(ts, AT)})
    return scratch.result(rows.select(*log.columns, F.col("_row").alias("history_seq"), "created_at"))


def segments(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Gaps and islands: runs of equal values, in order, with their ends and length.

    A range's first row of a key is held against the key's last row in the range before it. Runs are counted by key and
    range first, so a long one is as few rows as the ranges that it crosses.
    """
    scratch = Scratch(log.sparkSession, "segments")
    rows = _ranged(scratch, log.select(key, F.col(value).alias("_value"), *order), [key], order)
    ends = rows.groupBy(key, RANGE).agg(F.max_by(F.struct("_value"), AT).alias("_end"))
    prior = ends.select(key, RANGE, F.expr(f"lag(_end) over (partition by {key} order by {RANGE})").alias("_prior"))
    local = f"over (partition by {key}, {RANGE} order by {AT})"
    last = F.expr(f"coalesce(lag(struct(_value)) {local}, _prior)")  # null before the key's first row
    runs = _with(rows, prior, [key]).withColumn("_last", last).withColumn("_change", F.when(F.col("_last").isNotNull() & F.col("_last._value").eqNullSafe(F.col("_value")), 0).otherwise(1))
    local_runs = runs.withColumn("_run", F.expr(f"sum(_change) {local}"))
    parts = local_runs.groupBy(key, RANGE, "_run", "_value").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n"), F.sum("_change").alias("_new"))
    parts = scratch.written(parts)
    offset = parts.groupBy(key, RANGE).agg(F.sum("_new").alias("_new")).select(key, RANGE, F.expr(f"sum(_new) over (partition by {key} order by {RANGE}) - _new").alias("_before"))
    whole = _with(parts.drop("_new"), offset, [key]).withColumn("segment", F.col("_run") + F.col("_before"))
    return scratch.result(whole.groupBy(key, "segment", F.col("_value").alias(value)).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")))
