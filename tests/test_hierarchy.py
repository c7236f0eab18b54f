"""Closures against a recursive query and plain searches."""

import random
from collections import deque

import duckdb
import pytest

from assaylake.operators import hierarchy


def closure(spark, edges):
    return sorted(tuple(r) for r in hierarchy.closure(spark.createDataFrame(edges, "child string, parent string")).collect())


def by_search(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = []
    for start in up:
        far, todo = {}, deque((x, 1) for x in up[start])
        while todo:
            x, d = todo.popleft()
            if x not in far:
                far[x] = d
                todo += [(y, d + 1) for y in up.get(x, ())]
        out += [(start, x, d) for x, d in far.items()]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 6, 7, 40])
def test_chains_of_any_length(spark, n):
    edges = [(f"x{i}", f"x{i + 1}") for i in range(n)]
    got = closure(spark, edges)
    assert len(got) == n * (n + 1) // 2 and got == by_search(edges)
    c = duckdb.connect()
    c.execute("create table e(child varchar, parent varchar)")
    c.executemany("insert into e values (?, ?)", edges)
    want = c.execute("with recursive up as (select child, parent as ancestor from e union select up.child, e.parent from up join e on up.ancestor = e.child) select * from up").fetchall()
    assert sorted(want) == [x[:2] for x in got]


def test_cycles_and_several_parents(spark):
    assert closure(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")]) == by_search([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")])
    rng = random.Random(5)
    for n, m in ((12, 14), (30, 45)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        assert closure(spark, edges) == by_search(edges)


def test_defined_cases(spark):
    assert closure(spark, [("a", "b"), ("a", "b"), (None, "b"), ("b", None), (None, None)]) == [("a", "b", 1)]
    assert closure(spark, []) == []


def test_known_pairs_are_joined_where_they_lie(spark):
    from assaylake.shared import Bucketed, conf

    with conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        with Bucketed(spark, "pairs", "child") as known:
            for k in (1, 2):  # several additions are one set of buckets
                known.add(known.dealt(spark.createDataFrame([(f"x{i}", f"y{i}", k) for i in range(9)], "child string, ancestor string, distance int")))
            far = known.dealt(spark.createDataFrame([("x1", "y1"), ("x1", "z")], "child string, ancestor string"))
            new = far.join(known.rows(), ["child", "ancestor"], "left_anti")
            assert [tuple(r) for r in new.collect()] == [("x1", "z")]
            assert new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1  # of far alone
            assert known.result().count() == 18
        assert not spark.catalog.tableExists(known.table)
    closure(spark, [("a", "b"), ("b", "c")])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("closure_")]
