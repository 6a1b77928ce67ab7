"""Registered queries read all of a table."""

import numpy as np

from manifolder.operators import gradients
from manifolder.plans.queries import QUERIES


def test_centered_kernel_of_all_points(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(75, 4))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    v = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = v - v.mean(axis=1, keepdims=True) - v.mean(axis=0, keepdims=True) + v.mean()
    got = {(r.i, r.j): r.k for r in QUERIES["centered_kernel"](spark, str(tmp_path)).collect()}
    assert len(got) == 75 * 75 and all(abs(got[i, j] - want[i, j]) < 2e-6 for i in range(75) for j in range(75))


def test_centered_kernel_is_by_blocks(spark):
    """Before, each pair was a row that met three tables of means; far from zero the products hold too."""
    x = np.random.default_rng(4).normal(size=(60, 3)) + 1000
    points = spark.createDataFrame([(i * 7, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")
    v = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = v - v.mean(axis=1, keepdims=True) - v.mean(axis=0, keepdims=True) + v.mean()
    found = gradients.centered_kernel(points)
    got = {(r.i, r.j): r.k for r in found.collect()}
    assert len(got) == 3600 and all(abs(got[i * 7, j * 7] - want[i, j]) < 1e-6 for i in range(60) for j in range(60))
    long = {(r.i, r.j): r.k for r in gradients.centered(gradients.pairwise_squared(points)).collect()}
    assert all(abs(got[p] - long[p]) < 1e-6 for p in got)


def test_turned_pairs_share_their_bytes(spark, tmp_path):
    """Before, a written pair took over eight bytes, and blocks met twice."""
    x = np.random.default_rng(5).normal(size=(900, 8))
    points = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    gradients.centered_kernel(points, 6).write.parquet(str(tmp_path / "k"))
    found = spark.read.parquet(str(tmp_path / "k")).toArrow()
    i, j, k = (found.column(c).to_numpy() for c in "ijk")
    x = x - x.mean(axis=0)
    assert len(np.unique(i * 900 + j)) == len(k) == 810_000 and np.abs(k + 2 * (x[i] * x[j]).sum(axis=1)).max() < 1e-6
    assert sum(f.stat().st_size for f in (tmp_path / "k").glob("*.parquet")) < 6 * len(k)


def test_rounding_is_that_of_sql():
    got = gradients.rounded(np.array([1 / 128, -1 / 128, -1e-9, 0.4e-6, 1e300, np.nan, 2.3456785]), 6)
    assert got[:5].tolist() == [0.007813, -0.007813, 0.0, 0.0, 1e300] and np.isnan(got[5]) and got[6] in (2.345678, 2.345679)
    assert not np.signbit(got[2])
