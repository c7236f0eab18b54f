"""Nearest vectors above a score, exactly, without looking at every pair of blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.shared import Scratch

#: Angles are compared with this room for rounding, so no block is skipped that may hold a match.
ROOM = 1e-7


@dataclass(frozen=True)
class Plan:
    #: Rows of a part that one task scores.
    block: int = 4096
    #: Pivots at most; they and the radii of their parts are what goes to the driver and to every task.
    most_pivots: int = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. They are first divided by a power of two, which is exact, so that no square over- or underflows."""
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ pivots.T, -1, 1))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows with an id and a finite vector other than zero."""
    e = F.col("embedding").cast("array<double>")
    fine = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _placed(pivots: np.ndarray):
    """The rows with the part of their nearest pivot and the angle to it."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                a = angles(matrix(b.column("embedding")), pivots)
                part = a.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(part.astype(np.int32)), pa.array(a[np.arange(len(part)), part])], ["vec_id", "embedding", "part", "angle"])

    return run


def _visits(pivots: np.ndarray, radius: np.ndarray, parts: np.ndarray, least: float):
    """Of each query the parts, its own aside, that may hold a better match than its ``bound``: those whose nearest point is within reach."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a = angles(matrix(b.column("embedding")), pivots[parts])
            reach = np.arccos(np.clip(np.fmax(b.column("bound").to_numpy(zero_copy_only=False), least), -1, 1))
            own = b.column("part").to_numpy()
            q, p = np.nonzero((a - radius <= reach[:, None] + ROOM) & (parts[None, :] != own[:, None]))
            for i in range(0, len(q), 20_000):
                rows = b.take(pa.array(q[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("embedding"), pa.array(parts[p[i : i + 20_000]].astype(np.int32))], ["vec_id", "embedding", "part"])

    return run


def _best(k: int, least: float):
    """query_id, vec_id, score: of each query of a cell the k best of its vectors with another id, at ``least`` or above."""

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        out = []
        if asks.any() and not asks.all():
            x, ids = unit(matrix(t.column("embedding"))), t.column("vec_id").to_numpy()
            rows, own, queries, names = x[~asks], ids[~asks], x[asks], ids[asks]
            for i in range(0, len(queries), 256):
                near = queries[i : i + 256] @ rows.T
                near[names[i : i + 256, None] == own[None, :]] = -2
                for j, s in enumerate(near, i):
                    few = np.flatnonzero(s >= least - ROOM)
                    if len(few) > k:
                        few = few[s[few] >= np.partition(s[few], -k)[-k] - ROOM]
                    exact = (rows[few] * queries[j]).sum(1)  # does not depend on the rows' places
                    few, exact = few[exact >= least], exact[exact >= least]
                    top = np.lexsort((own[few], -exact))[:k]
                    out += [(int(names[j]), int(own[few[m]]), float(exact[m])) for m in top]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _scored(index: DataFrame, asks: DataFrame, sizes: dict[int, int], k: int, least: float, block: int) -> DataFrame:
    """The best of each query in the parts that it visits. A part is cut into blocks, and each meets the part's queries in blocks."""
    spark = index.sparkSession
    down = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most as many as pivots
    ceil = lambda n: -(-n // block)
    grid = spark.createDataFrame([(p, ceil(sizes[p]), ceil(n)) for p, n in down.items() if p in sizes], "part int, across int, down int")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = index.join(F.broadcast(grid), "part").select("vec_id", "embedding", "part", F.lit(False).alias("asks"), own("across").alias("i"), every("down").alias("j"))
    q = asks.join(F.broadcast(grid), "part").select("vec_id", "embedding", "part", F.lit(True).alias("asks"), every("across").alias("i"), own("down").alias("j"))
    return v.unionByName(q).groupBy("part", "i", "j").applyInArrow(_best(k, least), "query_id long, vec_id long, score double")


@dataclass
class Found:
    """matches: query_id, rank, vec_id, score; pairs of queries and parts that there are, and that were scored."""

    matches: DataFrame
    pairs: int
    scored: int


def search(queries: DataFrame, vectors: DataFrame, k: int, least: float, plan: Plan = Plan()) -> Found:
    """Of each query the k nearest vectors of another id by cosine at or above ``least``, ties to the smaller id.

    Vectors stand in the part of their nearest pivot; a part has the largest angle to it as radius. Angles keep the
    triangle inequality, so no vector of a part is nearer to a query than the pivot less the radius. A query is scored
    against its own part first; its k-th score there bounds what others have to offer, and only the parts that may
    reach it are scored. Pivots are the vectors of the lowest hashes, two for a block's worth of rows.

    Vectors that are null, zero, not finite, or of another length than the pivots' most common one take no part.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = valid(vectors)
    n = rows.count()
    want = min(max(1, -(-2 * n // plan.block)), plan.most_pivots)
    picked = [r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(want).collect()]
    if not picked:
        return Found(vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0, 0)
    length = int(np.bincount([len(e) for e in picked]).argmax())
    pivots = unit(np.unique(np.array([e for e in picked if len(e) == length]), axis=0))
    place = lambda df: df.filter(F.size("embedding") == length).mapInArrow(_placed(pivots), "vec_id long, embedding array<double>, part int, angle double")
    index = scratch.written(place(rows))
    asks = scratch.written(place(valid(queries)))
    facts = index.groupBy("part").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most as many as pivots
    sizes = {r["part"]: r["n"] for r in facts}

    near = scratch.written(_scored(index, asks, sizes, k, least, plan.block))
    best = F.array_sort(F.collect_list("score"), lambda a, b: F.sign(b - a).cast("int"))  # at most k for each block of the query's part
    bound = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.get(best, F.lit(k - 1)).alias("bound"))
    parts, radius = np.array([r["part"] for r in facts]), np.array([r["radius"] for r in facts])
    known = asks.join(bound, "vec_id", "left")
    others = scratch.written(known.mapInArrow(_visits(pivots, radius, parts, least), "vec_id long, embedding array<double>, part int"))
    every = near.unionByName(_scored(index, others, sizes, k, least, plan.block))
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int")
    matches = every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
    asked = asks.count()
    scored = asked + others.count()
    return Found(scratch.result(matches), asked * len(facts), scored)


def top_matches(queries: DataFrame, vectors: DataFrame, k: int, least: float, plan: Plan = Plan()) -> DataFrame:
    return search(queries, vectors, k, least, plan).matches
