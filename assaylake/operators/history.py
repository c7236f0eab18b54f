"""Versioned run history: latest heads, version numbers, tails, contiguous segments, drift against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key the row with the largest ``order``: an aggregation, so hot keys combine before the shuffle."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns, order), order).alias("head")).select(*keys, *[f"head.{c}" for c in (*columns, order)])


def latest_authoritative(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest that is no replay, so replays never chain."""
    return latest(log.filter("replay_of is null or replay_of = ''"), keys, order, columns)


def tail(log: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n of each key, numbered from the oldest of them. The planner keeps n of a key in each task before rows are moved."""
    down, up = ", ".join(f"{x} desc" for x in order), ", ".join(order)
    kept = log.withColumn("k", F.expr(f"row_number() over (partition by {key} order by {down})")).filter(F.col("k") <= n).drop("k")
    return kept.withColumn("place", F.expr(f"row_number() over (partition by {key} order by {up})"))


def every_nth(cases: DataFrame, stride: int, key: str, within: str, width: int = 4096) -> DataFrame:
    """Of each ``stride`` cases in order the last is test, the others train. ``key`` is a number.

    Places are counted within ranges of ``width`` keys; only the ranges' counts go through a window of a whole group.
    """
    ranged = cases.withColumn("_range", F.floor(F.col(key) / width))
    starts = ranged.groupBy(within, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.expr(f"coalesce(sum(_n) over (partition by {within} order by _range rows between unbounded preceding and 1 preceding), 0)")).drop("_n")
    placed = ranged.withColumn("_at", F.expr(f"row_number() over (partition by {within}, _range order by {key}) - 1")).join(starts, [within, "_range"])
    split = F.when((F.col("_start") + F.col("_at")) % stride == stride - 1, "test").otherwise("train")
    return placed.withColumn("split", split).drop("_range", "_at", "_start")


def audit(log: DataFrame, actor: str | None = None, target: int | None = None, since: str | None = None) -> DataFrame:
    """Audit rows that meet all given conditions; conditions reach the scan."""
    if actor is not None:
        log = log.filter(F.col("agent") == actor)
    if target is not None:
        log = log.filter(F.col("case_key") == target)
    if since is not None:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return log


def latency_percentiles(log: DataFrame, key: str, value: str, width: float = 1.0) -> DataFrame:
    """Exact median and 95th percentile of each key, between neighbours where the place is not whole; null values do not count.

    Values are counted by buckets of ``width``, which tell the buckets that hold the wanted places; only the rows of these
    buckets are ranked, so a key with many rows is not gathered.
    """
    rows = log.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"), F.floor(F.col(value) / width).alias("bucket"))
    counts = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cum = counts.select("key", "bucket", "n", F.expr("sum(n) over (partition by key order by bucket) - n").alias("before"), F.expr("sum(n) over (partition by key)").alias("total"))
    wanted = cum.select("*", F.explode(F.array(F.lit(0.5), F.lit(0.95))).alias("p")).withColumn("place", F.col("p") * (F.col("total") - 1))
    side = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("at")
    wanted = wanted.select("key", "bucket", "before", "n", "total", "p", "place", side).filter("at >= before and at < before + n")
    ranked = rows.join(wanted.select("key", "bucket").distinct(), ["key", "bucket"], "left_semi").withColumn("rank", F.expr("row_number() over (partition by key, bucket order by x) - 1"))
    found = wanted.join(ranked, ["key", "bucket"]).filter("rank = at - before")
    share = F.when(F.ceil("place") == F.floor("place"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("place")))
    each = found.groupBy("key", "p", "total").agg(F.round(F.sum(F.col("x") * share), 6).alias("q"))
    of = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
    return each.groupBy(F.col("key").alias(key)).agg(F.max("total").alias("n"), of(0.5).alias("p50"), of(0.95).alias("p95"))


def diff_verdicts(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Full outer join of two verdict sets; a missing side is ABSENT. Only differences."""
    b, c = baseline.select(key, F.col("verdict").alias("baseline")), current.select(key, F.col("verdict").alias("current"))
    j = b.join(c, key, "full_outer").select(key, F.coalesce("baseline", F.lit("ABSENT")).alias("baseline"), F.coalesce("current", F.lit("ABSENT")).alias("current"))
    return j.filter("baseline <> current")


def flag_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Codes that came and went for each case, as ``+a +b -c``."""
    both = baseline.select("case_id", "code").distinct().withColumn("old", F.lit(True)).join(current.select("case_id", "code").distinct().withColumn("new", F.lit(True)), ["case_id", "code"], "full_outer")
    signs = both.filter("old is null or new is null").withColumn("mark", F.concat(F.when(F.col("new"), "+").otherwise("-"), F.col("code")))
    return signs.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("mark")), " ").alias("delta"))


def union_history(stores: list[tuple[int, DataFrame]], key: str) -> DataFrame:
    """Rows of several stores; of each key that of the lowest priority number."""
    rows = [df.withColumn("priority", F.lit(p)) for p, df in stores]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    others = [c for c in out.columns if c not in (key, "priority")]
    return out.groupBy(key).agg(F.min_by(F.struct(*others, "priority"), "priority").alias("x")).select(key, "x.*")
