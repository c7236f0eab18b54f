"""Connected components of an edge table by alternating large and small stars.

Every step is a join and an aggregation over edges; partitions first replace their own edges by a forest. The edges of a
node with a large share of them all are not gathered in one task (``join_hot``). Steps are written to the shared folder,
so neither lineage nor the driver grows with the graph.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import discard, join_hot, written


class UnionFind:
    """Components with the smallest member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while parent.get(x, root) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.parent)
        return nodes, [self.find(x) for x in nodes]


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each node of a partition; a > b."""

    def run(batches):
        found = UnionFind()
        for x in batches:
            for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                if a != b:
                    found.union(a, b)
        a, b = found.stars()
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000], pa.int64()), pa.array(b[i : i + 100_000], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long").filter("a <> b")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")).select("a", F.least("a", "m").alias("m"), "k")
    return join_hot(both, least, "a", "k", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
    kept = join_hot(down, least, "a", "k", total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return kept.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of the edges (a, b). The edges are not read again afterwards."""
    spark, folders = edges.sparkSession, []
    now, last = written(_forest(edges), "edges", folders), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last, before = state, list(folders)
        now = written(_forest(_small_star(_large_star(now, state[0]), state[0]).distinct()), "edges", folders)
        discard(spark, before)
        del folders[: len(folders) - 1]
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
