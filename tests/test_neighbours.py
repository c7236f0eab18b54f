"""Nearest vectors above a score against all pairs, and how many parts are skipped."""

import numpy as np
import pytest

from assaylake.operators import neighbours
from assaylake.operators.neighbours import Plan


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def brute(queries, x, k, least):
    out = []
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in queries:
        s = u @ u[q]
        order = sorted((i for i in range(len(x)) if i != q and s[i] >= least), key=lambda i: (-s[i], i))[:k]
        out += [(q, r + 1, i, round(float(s[i]), 6)) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
@pytest.mark.parametrize("least", [-1.0, 0.1, 0.8])
def test_matches_are_those_of_all_pairs(spark, spread, least):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 8))[rng.integers(0, 20, 400)] + spread * rng.standard_normal((400, 8))
    df = table(spark, x)
    found = neighbours.search(df.filter("vec_id % 10 = 0"), df, 3, least, Plan(block=40))
    assert sorted(map(tuple, found.matches.collect())) == brute(range(0, 400, 10), x, 3, least)
    assert found.scored <= found.pairs
    if spread < 1:  # clusters: most parts are out of reach
        assert found.scored < 0.4 * found.pairs


def test_defined_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [0.0, 1e200]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.top_matches(df, df, 2, 0.5).dropDuplicates().collect()))
    half = round(0.5**0.5, 6)
    assert [g for g in got if g[0] == 1] == [(1, 1, 2, 1.0), (1, 2, 8, half)]
    assert [g for g in got if g[0] == 3] == [(3, 1, 8, half), (3, 2, 8, half)]
    assert {g[0] for g in got} == {1, 2, 3, 8}
    assert neighbours.top_matches(df.filter("false"), df, 2, 0.5).count() == 0 and neighbours.top_matches(df, df.filter("false"), 2, 0.5).count() == 0


def test_a_part_of_many_copies_is_dealt_over_blocks(spark):
    x = np.vstack([np.tile([[1.0, 1.0, 0.0]], (300, 1)), np.eye(3), -np.eye(3)])
    df = table(spark, x)
    got = sorted(map(tuple, neighbours.top_matches(df.filter("vec_id in (0, 299, 300)"), df, 4, 0.1, Plan(block=50)).collect()))
    assert got == brute([0, 299, 300], x, 4, 0.1)
