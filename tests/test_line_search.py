"""Neighbours along a line."""

import re

import numpy as np
import pytest

from manifolder.operators import knn
from manifolder.plans import queries


def listed(x, k, power):
    d = np.sqrt((x[:, None] - x[None, :]) * (x[:, None] - x[None, :])) ** power
    return {(i, n + 1): (int(j), d[i, j]) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), np.arange(len(x)) != i, d[i]))[:k])}


def on_a_line(spark, x):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "id long, x double").repartition(3)


def test_only_blocks_within_reach_meet(spark, sf):
    """Before, every block of the search met every other."""
    plan = queries.QUERIES["knn_callable"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    crossed = re.findall(r".*(?:CartesianProduct|BroadcastNestedLoopJoin).*", plan)
    assert crossed and all("hi#" in line and "low#" in line for line in crossed)


def test_blocks_that_meet_grow_with_the_points(spark):
    meet = []
    for n in (3000, 12000):
        _, left, right = knn._line_blocks(on_a_line(spark, np.random.default_rng(1).normal(size=n)), 4, 1.0, 50)
        meet.append(left.join(right, (right.hi >= left.low) & (right.lo <= left.high)).count())
        assert meet[-1] < 4 * n / 50
    assert meet[1] < 5 * meet[0]


@pytest.mark.parametrize("power", [1.0, 0.5])
@pytest.mark.parametrize(
    "x",
    [
        np.random.default_rng(2).normal(size=600),
        np.round(np.random.default_rng(3).normal(size=600), 1),  # ties on both sides
        np.r_[np.full(400, 0.25), np.random.default_rng(4).normal(size=100), 1e6],  # a group of copies over many blocks
        np.r_[np.arange(300) * 1e-164, np.arange(50) * 1e-160, -0.0, 0.0, 1.0],  # squares that are all 0
        1e9 + np.random.default_rng(5).random(size=300),
        np.r_[np.zeros(3), np.exp(np.arange(300) * 0.1)],  # sparse beside dense
        np.array([3.0, 1.0]),
    ],
)
def test_lists_are_those_of_all_pairs(spark, x, power):
    got = knn.knn_line(on_a_line(spark, x), 5, power, block_rows=16).collect()
    want = listed(x, 5, power)
    assert len(got) == len(want) and {(r.i, r.rank): (r.j, r.d) for r in got} == want


def test_points_without_a_number_have_no_lists(spark):
    got = knn.knn_line(on_a_line(spark, [1.0, None, float("nan"), 2.0, float("inf")]), 3, 1.0).collect()
    assert sorted((r.i, r.rank, r.j, r.d) for r in got) == [(0, 1, 0, 0.0), (0, 2, 3, 1.0), (3, 1, 3, 0.0), (3, 2, 0, 1.0)]
    assert knn.knn_line(on_a_line(spark, [1.0]).where("id < 0"), 3).collect() == []
    with pytest.raises(ValueError):
        knn.knn_line(on_a_line(spark, [1.0]), 3, 0.0)
