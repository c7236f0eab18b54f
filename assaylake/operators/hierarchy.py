"""Closures over hierarchies of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.shared import Bucketed, conf


def closure(edges: DataFrame) -> DataFrame:
    """child, ancestor, distance (the least number of steps) of an is-a hierarchy (child, parent), to its fixpoint.

    Rounds double the reach: a pair at a distance of over ``reach`` steps passes a node that is exactly ``reach`` steps from
    the child and is known at that distance, so only these last pairs are joined, with all pairs known. What is known
    already is taken out by an anti-join, so cycles end, and the rounds are as many as the logarithm of the longest
    distance. Pairs lie in buckets by child: each is shuffled once, when it is found, and is joined, compared and returned
    where it lies.

    Edges with a null end are left out; repeated edges are one; a node of a cycle is its own ancestor at the cycle's
    length, as it is at 1 where it is its own parent.
    """
    spark = edges.sparkSession
    pairs = edges.filter("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    found = Bucketed(spark, "closure", "child")
    # buckets by child serve joins by child and ancestor too
    with found, conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        found.add(found.dealt(pairs).distinct())
        reach = 1
        while not (last := found.rows().filter(F.col("distance") == reach)).isEmpty():
            step = last.withColumnsRenamed({"ancestor": "middle", "distance": "to"})
            on = found.rows().withColumnsRenamed({"child": "middle", "distance": "more"})
            far = found.dealt(step.join(on, "middle").select("child", "ancestor", (F.col("to") + F.col("more")).alias("distance")))
            least = far.groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))
            found.add(least.join(found.rows().select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
            reach *= 2
        return found.result()
