"""Neighbour search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manifolder.functions.vector import METRICS
from manifolder.operators import blocks, knn
from manifolder.operators.blocks import distances
from manifolder.plans.queries import QUERIES

ROWS = [(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(1).normal(size=(120, 5)))] + [(120, [0.0] * 5), (121, [0.0] * 5), (122, [1.0] * 5), (123, [1.0] * 5)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(ROWS, "id long, x array<double>").repartition(3)


def brute(k, metric, power=0.5):
    x = np.array([v for _, v in ROWS])
    out = {}
    for i, row in enumerate(x):
        if metric == "euclidean":
            d = np.sqrt(((x - row) ** 2).sum(axis=1))
        else:
            norms = np.linalg.norm(x, axis=1) * np.linalg.norm(row)
            zero = (np.linalg.norm(x, axis=1) == 0).astype(int) + (np.linalg.norm(row) == 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.where(zero == 2, 0, np.where(zero == 1, 1, 1 - x @ row / norms))
        d = np.round(np.maximum(d, 0), 12)
        order = sorted(range(len(x)), key=lambda j: (d[j], j != i, j))[:k]
        out[i] = [(j, d[j] ** power) for j in order]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("search", ["blocks", "expressions"])
def test_exact(points, metric, search):
    found = knn.knn_exact(points, 6, metric, block_rows=17) if search == "blocks" else knn.knn_expressions(points, 6, metric)
    want = brute(6, metric)
    rows = found.collect()
    assert len(rows) == 6 * len(ROWS)
    for r in rows:
        assert abs(want[r.i][r.rank - 1][1] - r.d) < 1e-5
    if metric == "euclidean":
        assert all(want[r.i][r.rank - 1][0] == r.j for r in rows)


def test_distance_power_and_k_beyond_points(points):
    few = points.where("id < 4")
    rows = knn.knn_exact(few, 10, distance_power=1.0).collect()
    assert len(rows) == 16 and {r.j for r in rows if r.rank == 1} == {0, 1, 2, 3}


def test_block_distances_equal_expressions(spark, points):
    pairs = points.where("id < 5").select(F.col("id").alias("i"), F.col("x").alias("a")).crossJoin(points.select(F.col("id").alias("j"), F.col("x").alias("b")))
    x = np.array([v for _, v in ROWS])
    for metric in METRICS:
        d = distances(x[:5], x, metric)
        for r in pairs.select("i", "j", METRICS[metric](F.col("a"), F.col("b")).alias("d")).collect():
            assert r.d == pytest.approx(d[r.i, r.j], abs=1e-15)


def test_descent_recall_and_no_repeats(spark):
    x = np.random.default_rng(2).uniform(size=(500, 5))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, [0.0] * 5), (501, [0.0] * 5)], "id long, x array<double>")
    found = knn.knn_descent(spark, points, 10).persist()
    assert found.groupBy("i", "j").count().where("count > 1").count() == 0
    assert knn.recall(found, knn.knn_exact(points, 10)).first().recall >= 0.98


def test_leaves_cover_every_point_once(spark, points):
    leaves = knn.random_projection_leaves(spark, points, 3, 12)
    assert leaves.groupBy("tree", "id").count().where("count <> 1").count() == 0
    assert leaves.count() == 3 * len(ROWS)


@pytest.mark.parametrize("task_rows", [20_000, 16])
def test_leaves_are_bounded_even_of_equal_points(spark, task_rows):
    """Whether split in one task or routed by planes over a sample first; most points are one and the same."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(150)] + [(150 + i, [float(i), float(i % 7), 0.0]) for i in range(50)]
    points = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    sizes = lambda tree, node, ids, x, runs: pa.table({"id": (runs := [ids[r] for r in runs]) and np.concatenate(runs), "size": np.repeat([len(r) for r in runs], [len(r) for r in runs])})
    got = knn._forest(points, 2, 9, 0, sizes, "id long, size long", task_rows).collect()
    assert sorted(r.id for r in got) == sorted(2 * [k for k, _ in rows]) and max(r.size for r in got) <= 9


def test_short_lists_are_filled(spark, points):
    """From a graph that leaves most points with few neighbours or none, every point ends with k."""
    initial = spark.createDataFrame([(0, 1), (1, 0), (2, 5)], "i long, j long")
    found = knn.knn_descent(spark, points, 6, initial=initial).persist()
    assert {r["count"] for r in found.groupBy("i").count().collect()} == {6} and found.select("i").distinct().count() == len(ROWS)
    assert found.where("rank = 1 and i = j").count() == len(ROWS)
    few = knn.knn_descent(spark, points.where("id < 4"), 10, initial=initial.where("i < 2"))
    assert few.count() == 16


def test_callable_distances(spark, points):
    def city(a, b):
        return np.abs(a[:, None] - b[None]).sum(axis=2)

    x = np.array([v for _, v in ROWS])
    want = np.sort(city(x, x), axis=1)[:, :4]
    exact, found = knn.knn_exact(points, 4, city, distance_power=1.0), knn.knn_descent(spark, points, 4, city, distance_power=1.0)
    rows = exact.collect()
    assert len(rows) == 4 * len(ROWS) and all(abs(want[r.i][r.rank - 1] - r.d) < 1e-9 for r in rows)
    assert all(abs(city(x[[r.i]], x[[r.j]])[0, 0] - r.d) < 1e-9 for r in found.collect())
    assert knn.recall(found, exact).first().recall > 0.9


def test_callable_search(spark, points):
    found = knn.nearest_neighbors(spark, points, 3, strategy=lambda p, k: knn.knn_exact(p, k, distance_power=1.0)).collect()
    assert len(found) == 3 * len(ROWS)
    with pytest.raises(ValueError):
        knn.nearest_neighbors(spark, points, 3, strategy=lambda p, k: p)
    with pytest.raises(ValueError):
        knn.nearest_neighbors(spark, points, 3, strategy="none")


def test_diversify_follows_its_definition(spark, points):
    lists = knn.knn_exact(points, 8, distance_power=1.0)
    x = np.array([v for _, v in ROWS])
    want = {}
    for i, near in brute(8, "euclidean", 1.0).items():
        kept = []
        for j, d in near:
            if j != i and not any(dc > 1e-8 and np.sqrt(((x[c] - x[j]) ** 2).sum()) < d - 1e-12 for c, dc in kept):
                kept.append((j, d))
        want[i] = [j for j, _ in kept]
    got = {}
    for r in knn.diversify(lists, points, distance_power=1.0).orderBy("i", "rank").collect():
        got.setdefault(r.i, []).append(r.j)
    assert got == want


def test_degree_prune_keeps_ties(spark):
    edges = spark.createDataFrame([(0, k, w) for k, w in enumerate([1.0, 2.0, 2.0, 2.0, 3.0])] + [(1, 0, 5.0)], "head long, tail long, w double")
    assert sorted(r.w for r in knn.degree_prune(edges, 1).where("head = 0").collect()) == [1.0, 2.0, 2.0, 2.0]
    assert knn.degree_prune(edges, 10).count() == 6


def test_mutual_and_recall(spark):
    a = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0)], "i long, j long")
    assert [tuple(r) for r in knn.mutual(a).collect()] == [(0, 1)]
    assert knn.recall(a.limit(2), a).first().recall == 0.5


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_bounds_lose_no_neighbor(spark, metric, shift):
    """Ties of copies, many blocks, vectors far from zero: the lists of all pairs measured."""
    x = np.round(np.random.default_rng(5).normal(size=(300, 6)), 1) + shift
    x[100:180] = x[7]
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>").coalesce(1)
    d = np.sqrt(np.maximum(knn.distances(x, x, metric), 0.0))
    want = {(i, int(j)): d[i, j] for i in range(300) for j in np.lexsort((np.arange(300), np.arange(300) != i, d[i]))[:7]}
    got = {(r.i, r.j): r.d for r in knn.knn_exact(rows, 7, metric, block_rows=64).collect()}
    assert got == want


def test_bounds_leave_most_pairs_unmeasured(monkeypatch):
    """Before, each pair was measured dimension by dimension."""
    measured = []
    monkeypatch.setattr(knn, "pair_distances", lambda a, b, metric, f=knn.pair_distances: measured.append(len(a)) or f(a, b, metric))
    monkeypatch.setattr(knn, "distances", None)
    x = np.random.default_rng(6).normal(size=(4000, 8))
    lists = knn._Lists(np.arange(500), x[:500], 5, "euclidean", 0.5, None)
    for at in range(0, 4000, 500):
        lists.meet(np.arange(at, at + 500), x[at : at + 500])
    assert sum(measured) < 500 * 4000 / 50 and lists.rows().num_rows == 2500


def test_one_file_is_dealt_over_all_tasks(spark, points):
    assert blocks.paired(points.coalesce(1), 16, 32).rdd.getNumPartitions() >= 4


def test_expressions_measure_the_pairs_that_bounds_leave(spark):
    """Before, named metrics too were evaluated for all pairs, which were then sorted."""
    x = np.round(np.random.default_rng(9).normal(size=(250, 3)), 1)
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")
    found, every = knn.knn_expressions(rows, 4), knn.knn_expressions(rows, 4, METRICS["euclidean"])
    assert sorted(found.collect()) == sorted(every.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan(found) and "Join Cross" not in plan(found).split("MapInArrow")[0] and "Join Cross" in plan(every)


def test_own_search_by_one_coordinate(spark, tmp_path):
    """knn_callable: pairs that meet in the search aren't rows."""
    x = np.round(np.random.default_rng(10).normal(size=(90, 2)), 2)
    spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["knn_callable"](spark, str(tmp_path))
    d = np.sqrt(np.abs(x[:, None, 0] - x[None, :, 0]) ** 2)
    want = {(i, int(j)) for i in range(90) for j in np.lexsort((np.arange(90), np.arange(90) != i, d[i]))[:4]}
    assert {(r.i, r.j) for r in found.collect()} == want
    assert "Join Cross" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_auto_is_exact_for_more_points(spark, monkeypatch):
    """Before, 50,001 points went to NN-descent, which takes longer than the bounded search there."""
    monkeypatch.setattr(knn, "knn_exact", lambda *a, **b: "exact")
    monkeypatch.setattr(knn, "knn_descent", lambda *a, **b: "descent")
    assert [knn.nearest_neighbors(spark, spark.range(n), 5) for n in (60_000, 200_001)] == ["exact", "descent"]
