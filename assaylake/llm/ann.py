"""Approximate nearest neighbours by learned partitions.

A bounded sample of ``sample`` vectors (the lowest hashes of vec_id) goes to the driver, where its exact neighbour graph is
cut into balanced parts by recursive bisection, and a small network learns to tell from a vector the parts of its
neighbours. Every row is then indexed under its most probable part, and each query visits its most probable parts, as
many as held-out queries of the sample need for the recall aimed at. Visited vectors are scored exactly in double precision.

A part's vectors and queries meet in cells of bounded blocks of both, so a part that holds a third of all rows is dealt
over many tasks; cells return the best of each query, which are merged by rank.

Parts grow with the square root of the number of vectors, so that with structure in them a query scores a falling share.
The sample grows with the parts up to ``most_sample``; beyond, from 16 million vectors on, parts stay at 1024.

Vectors are divided by a power of two before they are squared, which is exact, so no magnitude over- or underflows.

Defined cases: vectors that are null, zero, of another length than the sample's most common one, or with null or
non-finite components take no part, nor do rows with a null vec_id; rows that repeat a vec_id are candidates each, but never for that vec_id's
query, and its query is its first row by value; ties go to the smaller vec_id; with fewer candidates all are returned;
an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import written


@dataclass(frozen=True)
class Plan:
    #: None: a quarter of the square root of the number of vectors, from 16 to a 32nd of the largest sample.
    parts: int | None = None
    #: Vectors that the partition and the classifier are fitted on, the lowest hashes of vec_id: 32 for each part, at least and at most so many.
    sample: int = 4096
    most_sample: int = 32_768
    neighbours: int = 10
    hidden: int = 128
    epochs: int = 40
    recall: float = 0.97
    block: int = 4096


def parts_for(rows: int, plan: Plan) -> int:
    return plan.parts or max(16, min(int(rows**0.5 / 4), max(plan.sample, plan.most_sample) // 32))


def sample_for(rows: int, plan: Plan) -> int:
    return max(plan.sample, min(32 * parts_for(rows, plan), plan.most_sample))


class Router:
    """Two layers and a softmax over the parts."""

    def __init__(self, weights: list[np.ndarray], visits: int):
        self.weights, self.visits = weights, visits

    @staticmethod
    def forward(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = weights
        h = np.maximum(x @ a + b, 0)
        return h, h @ c + d

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Parts of each vector from the most to the least probable."""
        return np.argsort(-self.forward(unit, self.weights)[1], axis=1, kind="stable")


def at_one(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = at_one(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of largest cosine other than the query itself; both are the same unit vectors."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 512):
        s = queries[i : i + 512] @ rows.T
        s[np.arange(len(s)), i + np.arange(len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node of a neighbour graph, sizes equal to one: recursive bisection at the median of the second eigenvector,
    then swaps of the pairs that gain most."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(3)
    todo = [(np.arange(n), parts, 0)]
    while todo:
        nodes, k, first = todo.pop()
        if k == 1:
            label[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        to = place[graph[nodes]]
        a, b = np.repeat(np.arange(len(nodes)), graph.shape[1]), to.ravel()
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        degree = np.maximum(np.bincount(a, minlength=len(nodes)), 1)
        v = rng.standard_normal(len(nodes))
        for _ in range(60):
            v = v - (v * degree).sum() / degree.sum()
            v = v / np.linalg.norm(v)
            v = 0.5 * v + 0.5 * np.bincount(a, v[b], len(nodes)) / degree
        left = k // 2
        cut = len(nodes) * left // k
        side = np.zeros(len(nodes), bool)
        side[np.argsort(v, kind="stable")[:cut]] = True
        for _ in range(20):
            inside = np.bincount(a, side[b], len(nodes)) / degree
            gain = np.where(side, 1 - 2 * inside, 2 * inside - 1)
            x, y = np.flatnonzero(side), np.flatnonzero(~side)
            x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
            m = min(len(x), len(y), max(1, len(nodes) // 50))
            good = np.flatnonzero(gain[x[:m]] + gain[y[:m]] > 0)
            if not len(good):
                break
            side[x[good]], side[y[good]] = False, True
        todo += [(nodes[side], left, first), (nodes[~side], k - left, first + left)]
    return label


def fit(vectors: np.ndarray, plan: Plan, k: int = 5, rows: int | None = None) -> Router | None:
    """None where the sample is too small to cut: all vectors are one part then, and the search is exact."""
    n = len(vectors)
    plan = replace(plan, parts=parts_for(rows or n, plan))
    if n < 8 * plan.parts:
        return None
    x = unit(vectors).astype(np.float32)
    graph = nearest(x, x, plan.neighbours)
    label = balanced_parts(graph, plan.parts)
    target = np.zeros((n, plan.parts), np.float32)
    for j in range(plan.neighbours):
        np.add.at(target, (np.arange(n), label[graph[:, j]]), 1 / (plan.neighbours + 1))
    target[np.arange(n), label] += 1 / (plan.neighbours + 1)
    rng = np.random.default_rng(5)
    d = x.shape[1]
    held = np.zeros(n, bool)
    held[rng.permutation(n)[: n // 8]] = True
    w = [rng.standard_normal((d, plan.hidden)).astype(np.float32) * np.sqrt(2 / d), np.zeros(plan.hidden, np.float32), rng.standard_normal((plan.hidden, plan.parts)).astype(np.float32) * np.sqrt(1 / plan.hidden), np.zeros(plan.parts, np.float32)]
    w[0] *= np.sqrt(d)  # unit vectors have components of about 1 / sqrt(d)
    m, v, step = [0 * p for p in w], [0 * p for p in w], 0
    train = np.flatnonzero(~held)
    for _ in range(plan.epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 256):
            at = train[i : i + 256]
            h, z = Router.forward(x[at], w)
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for p, grad in enumerate((x[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[p] = 0.9 * m[p] + 0.1 * grad
                v[p] = 0.999 * v[p] + 0.001 * grad * grad
                w[p] = w[p] - 3e-3 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8) - 1e-4 * w[p] * 3e-3
    router = Router(w, plan.parts)
    order = router.order(x)
    home, asks = order[:, 0], np.flatnonzero(held)
    best = nearest(x, x, k)[asks]
    rank = np.argsort(order[asks], axis=1)  # place of each part in the query's order
    places = np.take_along_axis(rank, home[best], axis=1)
    for visits in range(1, plan.parts + 1):
        if (places < visits).mean() >= plan.recall:
            break
    router.visits = visits
    return router


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    ok = F.size(e) > 0
    fine = ok & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _placed(rows: DataFrame, router: Router | None, visits: int | None) -> DataFrame:
    """The rows with their part, or with each part that they visit."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if router is None:
                part, take = np.zeros(b.num_rows, np.int32), np.arange(b.num_rows)
            else:
                order = router.order(unit(_matrix(b.column("embedding"))).astype(np.float32))[:, : visits or 1]
                part, take = order.ravel().astype(np.int32), np.repeat(np.arange(b.num_rows), order.shape[1])
            for i in range(0, len(part), 20_000):
                out = b.take(pa.array(take[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([out.column("vec_id"), out.column("embedding"), pa.array(part[i : i + 20_000])], ["vec_id", "embedding", "part"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, part int")


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Of each query the k rows of largest cosine with another id: (query, row, score). Scores do not depend on the rows' places."""
    queries, rows = at_one(queries), at_one(rows)
    qn, rn = np.sqrt((queries * queries).sum(1)), np.sqrt((rows * rows).sum(1))
    out = []
    for i in range(0, len(queries), 256):
        s = (queries[i : i + 256] @ rows.T) / qn[i : i + 256, None] / rn
        for j, row in enumerate(s, i):
            row[ids == query_ids[j]] = -np.inf
            few = np.flatnonzero(row > -np.inf)
            if len(few) > k:
                few = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-9)
                few = few[row[few] > -np.inf]
            exact = (rows[few] * queries[j]).sum(1) / (qn[j] * rn[few])
            top = np.lexsort((ids[few], -exact))[:k]
            out += [(int(query_ids[j]), int(ids[few[t]]), float(exact[t])) for t in top]
    return out


def _cell(k: int):
    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        got = []
        if asks.any() and not asks.all():
            x, ids = _matrix(t.column("embedding")), t.column("vec_id").to_numpy()
            got = best_of(x[asks], ids[asks], x[~asks], ids[~asks], k)
        cols = list(zip(*got)) or [[], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _cells(index: DataFrame, asks: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, score, rank: of each query the k best of the parts that it visits.

    A part is cut into blocks of vectors and of queries; each pair of blocks is a cell."""
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    grid = blocks(index, "across").join(blocks(asks, "down"), "part")  # at most as many rows as parts
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = index.join(F.broadcast(grid), "part").select("part", block_of("across").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), "vec_id", "embedding", F.lit(False).alias("asks"))
    down = asks.join(F.broadcast(grid), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), block_of("down").alias("j"), "vec_id", "embedding", F.lit(True).alias("asks"))
    found = left.unionByName(down).groupBy("part", "i", "j").applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, plan: Plan = Plan()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    A query whose parts hold fewer than k candidates visits all parts, so it gets k, or all candidates if fewer.
    """
    rows = _valid(vectors)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample_for(rows.count(), plan)).collect()
    sizes = np.bincount([len(r["embedding"]) for r in picked], minlength=1)
    length = int(sizes.argmax())
    rows = rows.filter(F.size("embedding") == length)
    router = fit(np.array([r["embedding"] for r in picked if len(r["embedding"]) == length]), plan, k, rows.count()) if picked else None
    index = written(_placed(rows, router, None), "ann-index")
    queries = written(index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    found = _cells(index, _placed(queries, router, router.visits if router else None), k, plan.block)
    if router is None or router.visits == len(router.weights[3]):
        return found
    found = written(found, "ann-found")
    full = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("vec_id")
    short = queries.join(full, "vec_id", "left_anti")
    again = _cells(index, _placed(short, router, len(router.weights[3])), k, plan.block)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)
