"""Ball k-means over whole numbers: exact clusters from few comparisons.

The members of a cluster within a task's block are a ball around the cluster's new centroid, with the largest of their exact
distances as radius. A centroid is a neighbour if half its distance from the ball's lies within that radius; the balls of no
other can hold a member. Half-distances to the neighbours, in ascending order, cut the ball into a stable core, whose
members stay without a comparison, and annuli, whose members are compared exactly with the neighbours below their own
distance and no others. All of it is integer arithmetic on squares, and a half-distance that equals a member's distance
counts as within, so ties go to the smaller number as they do when everything is compared.

The starting cluster may be any, so vectors aren't written anew each round: they stay under the cluster in which they were
last written, and are written anew when over a fourth have moved since. A round reads the table once, and what leaves a
task is a count and sums for each cluster. Rounds end early when no centroid changes, as all further ones are the same.

Components are scaled to ``floor(scale * x)``. Blocks of numbers so small that no square can overflow 64 bits
use such integers, others Python's. Sums leave the tasks in digits of 40 bits, so they are exact at any magnitude.

What goes to the driver: the initial centroids, and for each round sums by cluster and component, all bounded by the
number of clusters and components.

Defined cases: vectors that are null, of another length, or with null or non-finite components take no part; a null vec_id
is clustered but never an initial centroid; rows that repeat a vec_id are vectors each, as initial centroids in the order
of their components; with fewer vectors than clusters each is a centroid, and without any vec_id there are no clusters
and no rows; a distance or inertia beyond 64 bits is null;
an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import discard, releasing, written

DIGIT = 40


def small(components: int) -> int:
    """Below this, four times the squared distance of two vectors is below 2**63."""
    return math.isqrt((1 << 59) // components)


@dataclass(frozen=True)
class Plan:
    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: str = "3"
    #: Vectors are written anew under their clusters when more than one in so many has moved.
    moved: int = 4
    block: int = 8192


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers: 64-bit ones where they are small, else Python's."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    if not whole.size or np.abs(whole).max() < small(x.shape[1]):
        return whole.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 1 << 53 else math.floor(scale * v)
    return np.array([[exact(float(v)) for v in row] for row in x], dtype=object).reshape(x.shape)


def apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a centre, exact."""
    d = x - centre
    return (d * d).sum(1)


def relevant(home: int, between: np.ndarray, radius: int) -> list[int]:
    """The neighbours of a ball, nearest first: centroids half of whose distance lies within its radius."""
    near = [j for j in range(len(between)) if j != home and between[home, j] <= 4 * radius]
    return sorted(near, key=lambda j: (between[home, j], j))


def assign(x: np.ndarray, home: np.ndarray, centres: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, and the number of distances taken."""
    cluster, best, taken = home.copy(), np.empty(len(x), x.dtype), len(x)
    for i in np.unique(home):
        ball = np.flatnonzero(home == i)
        own = apart(x[ball], centres[i])
        number, least = np.full(len(ball), i), own.copy()
        inside = np.arange(len(ball))
        for j in relevant(i, between, own.max()):
            inside = inside[4 * own[inside] >= between[i, j]]  # beyond the half-distance: this annulus and those outside it
            d = apart(x[ball[inside]], centres[j])
            taken += len(inside)
            wins = (d < least[inside]) | ((d == least[inside]) & (j < number[inside]))
            least[inside[wins]], number[inside[wins]] = d[wins], j
        cluster[ball], best[ball] = number, least
    return cluster, best, taken


def whole(rows: list[list[int]]) -> np.ndarray:
    """A matrix of whole numbers, of 64 bits where all are small."""
    fits = all(abs(v) < small(len(row)) for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if fits else object)


def distances(centres: np.ndarray) -> np.ndarray:
    return np.array([apart(centres, c) for c in centres]).reshape(len(centres), len(centres))


def _blocks(batches, plan: Plan) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in blocks, with scaled components and starting clusters."""
    for whole_batch in batches:
        for k in range(0, whole_batch.num_rows, plan.block):
            b = whole_batch.slice(k, plan.block)
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield b, scaled(x.reshape(b.num_rows, plan.components), plan.scale), b.column("home").to_numpy()


def _assigner(centres: list[list[int]]):
    c = whole(centres)
    exact = c.astype(object)
    between = {kind: distances(m) for kind, m in ((c.dtype, c), (exact.dtype, exact))}

    def run(x: np.ndarray, home: np.ndarray):
        kind = x.dtype if x.dtype == c.dtype else exact.dtype
        return assign(x.astype(kind), home, c if kind == c.dtype else exact, between[kind])

    return run


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**40; the digits have its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest >>= DIGIT
        place += 1


def _sums(centres: list[list[int]], plan: Plan):
    """cluster, component, place, digit: the sums of a task's members; component -1 is their count, -2 the distances taken, -3 those that moved."""

    def run(batches):
        find = _assigner(centres)
        total = [[0] * plan.components for _ in centres]
        count, taken, moved = [0] * len(centres), 0, 0
        for _, x, home in _blocks(batches, plan):
            cluster, _, n = find(x, home)
            taken, moved = taken + n, moved + int((cluster != home).sum())
            for i in np.unique(cluster):
                members = x[cluster == i]
                count[i] += len(members)
                total[i] = [a + int(b) for a, b in zip(total[i], members.sum(0))]
        cells = [(i, -1, n) for i, n in enumerate(count)] + [(0, -2, taken), (0, -3, moved)]
        cells += [(i, j, v) for i, row in enumerate(total) for j, v in enumerate(row)]
        out = [(i, j, p, d) for i, j, v in cells for p, d in digits(v)]
        if out:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["cluster", "component", "place", "digit"])

    return run


def _members(centres: list[list[int]], plan: Plan):
    """The rows with their cluster as ``home``, and its distance."""

    def run(batches):
        find = _assigner(centres)
        for b, x, home in _blocks(batches, plan):
            cluster, best, _ = find(x, home)
            far = pa.array([int(d) if d < 1 << 63 else None for d in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cluster.astype(np.int32)), far], ["vec_id", "embedding", "home", "distance"])

    return run


def kept(vectors: DataFrame, components: int) -> DataFrame:
    """vec_id, embedding of the vectors that take part."""
    e = F.col("embedding")
    fine = (F.size(e) == components) & ~F.exists(e.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    as_double = e if dict(vectors.dtypes)["embedding"] == "array<float>" else e.cast("array<double>")
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), as_double.alias("embedding"))


def first_centroids(rows: DataFrame, plan: Plan) -> list[list[int]]:
    by_hash = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id is not null").orderBy(by_hash, "embedding").limit(plan.clusters).collect()
    return [[int(v) for v in row] for row in scaled(np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), plan.components), plan.scale)]


def update(sums: DataFrame, centres: list[list[int]]) -> tuple[list[list[int]], int, int]:
    """New centroids, the number of distances taken and of vectors that moved, from the tasks' digits."""
    rows = sums.groupBy("cluster", "component", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect()
    value: dict[tuple[int, int], int] = {}
    for r in rows:
        key = (r["cluster"], r["component"])
        value[key] = value.get(key, 0) + (int(r["digit"]) << (DIGIT * r["place"]))
    n = [value.get((i, -1), 0) for i in range(len(centres))]
    new = [[value.get((i, j), 0) // n[i] for j in range(len(c))] if n[i] else c for i, c in enumerate(centres)]
    return new, value.get((0, -2), 0), value.get((0, -3), 0)


@dataclass
class Clusters:
    """members: vec_id, home (the cluster), distance; centres; taken: distances taken in each round that was run."""

    members: DataFrame
    centres: list[list[int]]
    taken: list[int]


def cluster(vectors: DataFrame, plan: Plan = Plan()) -> Clusters:
    folders: list[str] = []
    spark = vectors.sparkSession
    rows = kept(vectors, plan.components).withColumn("home", F.lit(0))
    kind = dict(rows.dtypes)["embedding"]
    table = written(rows, "balls", folders)
    centres, n, taken = first_centroids(table, plan), table.count(), []
    run = lambda make, ddl: table.mapInArrow(releasing(make(centres, plan)), ddl)
    member = f"vec_id long, embedding {kind}, home int, distance long"
    for _ in range(plan.rounds if centres else 0):
        new, compared, moved = update(run(_sums, "cluster int, component int, place int, digit long"), centres)
        taken.append(compared)
        if moved * plan.moved > n:
            older = list(folders)
            folders.clear()
            table = written(run(_members, member).drop("distance"), "balls", folders)
            discard(spark, older)
        if new == centres:
            break
        centres = new
    if not centres:  # no vector has an id: nothing to start from
        return Clusters(table.filter("false").select("vec_id", "home", F.lit(None).cast("long").alias("distance")), [], taken)
    members = written(run(_members, member).select("vec_id", "home", "distance"), "balls-members")
    discard(spark, folders)
    return Clusters(members, centres, taken)


def cluster_digests(vectors: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found = cluster(vectors, plan)
    text = [",".join(map(str, c)) for c in found.centres]
    digest = F.element_at(F.array(*[F.lit(hashlib.sha256(t.encode()).hexdigest()) for t in text] or [F.lit(None).cast("string")]), F.col("home") + 1)
    # null where it isn't a 64-bit number
    exact = lambda n, s, missing: F.when(missing == 0, F.expr(f"try_cast({s} as bigint)")).alias(n)
    of_cluster = found.members.groupBy("home").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("missing"))
    # one row a cluster
    all_of = of_cluster.agg(F.sum("s").alias("all_s"), F.sum("missing").alias("all_missing"))
    sums = of_cluster.crossJoin(F.broadcast(all_of)).select(F.col("home").alias("h"), exact("cluster_inertia", "s", F.col("missing")), exact("inertia", "all_s", F.col("all_missing")))
    return found.members.join(F.broadcast(sums), F.col("home") == F.col("h")).select("vec_id", F.col("home").alias("cluster"), "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def oracle_sql(plan: Plan = Plan()) -> str:
    """All rounds in SQL, every distance compared."""
    v = f"""v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({plan.scale} * x::double) as bigint)) as x from embeddings
  where len(embedding) = {plan.components} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {plan.components}
)"""
    steps = [v, f"c0 as materialized (select row_number() over (order by sha256('{plan.seed}:' || vec_id), x) - 1 as k, x from v where vec_id is not null qualify k < {plan.clusters})"]
    near = lambda i: f"""a{i} as materialized (
  select r, arg_min(k, (d, k)) as k, min(d) as d from (
    select r, k, cast(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, c{i} c
  ) group by r
)"""  # noqa: E731
    for i in range(plan.rounds):
        steps += [near(i), f"""m{i} as materialized (
  select k, list(m order by j) as x from (
    select k, j, cast((s - ((s % n) + n) % n) // n as bigint) as m from (
      select k, j, cast(sum(y) as bigint) as s, count(*) as n from (select a.k, generate_subscripts(v.x, 1) as j, unnest(v.x) as y from v join a{i} a using (r)) group by k, j
    )
  ) group by k
), c{i + 1} as materialized (select c.k, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (k))"""]
    steps.append(near(plan.rounds))
    return f"""with {', '.join(steps)}
select v.vec_id, cast(a.k as integer) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from v join a{plan.rounds} a using (r) join c{plan.rounds} c on c.k = a.k"""
