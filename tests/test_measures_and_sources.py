"""Measures, resizing, sources, the sweep and the registered queries."""

import pickle
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from manifolder import cli
from manifolder.operators import gradients, metrics, resample
from manifolder.plans.oracles import SQL
from manifolder.plans.queries import QUERIES
from manifolder.plans.sweep import algorithm, sweep
from manifolder.sources import loaders, runs


def points_of(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, label long")


def test_accuracy_against_loop(spark):
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(63, 2)), rng.integers(0, 3, 63)
    n, size, k, folds = 63, 6, 7, []
    for f in range(9):
        test = np.arange(f * size, (f + 1) * size)
        train = np.setdiff1d(np.arange(n), test)
        hits = []
        for i in test:
            near = train[np.lexsort((train, ((x[train] - x[i]) ** 2).sum(axis=1)))[:k]]
            votes = Counter(label[near].tolist())
            hits.append(min(votes, key=lambda v: (-votes[v], v)) == label[i])
        folds.append(np.mean(hits))
    got = metrics.knn_accuracy(points_of(spark, [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]), k).first().accuracy
    assert got == pytest.approx(np.mean(folds))


def test_v_measure_ends(spark):
    same = spark.createDataFrame([(k % 3, 5 - k % 3) for k in range(30)], "label long, cluster long")
    assert metrics.v_measure(same).first().v_measure == pytest.approx(1)
    one = spark.createDataFrame([(k % 3, 0) for k in range(30)], "label long, cluster long")
    assert metrics.v_measure(one).first().v_measure == 0


def test_dbscan_against_loop(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.25, (25, 2)) for c in ((0, 0), (3, 0), (0, 4))] + [rng.uniform(-3, 7, (15, 2))])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    core = near.sum(axis=1) >= 5
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            v = todo.pop()
            if label[v] < 0 and core[v]:
                label[v] = i
                todo += np.flatnonzero(near[v]).tolist()
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else -1
    got = {r.id: r.cluster for r in metrics.dbscan(spark, points_of(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).collect()}
    assert got == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("model", ["kmeans", "dbscan", "spectral"])
def test_cluster_quality_of_clusters(spark, model):
    points = loaders.fake_clusters(spark, 80, 6, seed=3).withColumn("x", F.transform("x", lambda v: v * 4)).persist()
    found = metrics.cluster_quality(spark, points, model, **({"eps": 5.0} if model == "dbscan" else {})).first()
    assert found.v_measure > 0.9
    with pytest.raises(ValueError):
        metrics.cluster_quality(spark, points, "other")


def test_pca_against_svd(spark):
    x = np.random.default_rng(4).normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1]
    got = np.array([r.y for r in metrics.pca(points_of(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"k{v:03d}",) for v in range(300, 0, -1)], "k string").repartition(7)
    assert [tuple(r) for r in metrics.dense_ids(df, "k").orderBy("k").collect()] == [(f"k{v:03d}", v - 1) for v in range(1, 301)]


def loop_upsample(x, target):
    while len(x) < target:
        x = np.concatenate([x, x * 2])
    return x[:target]


def test_upsample_doubles_what_is_there(spark):
    x = np.arange(1.0, 8.0)
    got = resample.upsample(points_of(spark, [(i, [float(v)], i) for i, v in enumerate(x)]), 50).orderBy("id").collect()
    assert [r.x[0] for r in got] == loop_upsample(x, 50).tolist() and [r.label for r in got] == [i % 7 for i in range(50)]


def test_samples(spark):
    points = points_of(spark, [(i, [float(i)], i % 4) for i in range(43)])
    assert [r.id for r in resample.stride_sample(points, 10).orderBy("id").collect()] == list(range(0, 43, 4))
    assert resample.stride_sample(points, 100).count() == 100
    some = resample.stratified_subsample(points, 2, 3, [0, 3]).collect()
    assert Counter(r.label for r in some) == {0: 3, 3: 3}
    assert len({r.label for r in resample.stratified_subsample(points, 2, 3).collect()}) == 2
    with pytest.raises(ValueError):
        resample.stratified_subsample(points, 9, 3)
    assert resample.sample_without_replacement(points, 5).count() == 5
    assert sorted(resample.tile_dimensions(points, 3).first().x) == [0.0] * 3


def test_gradient_progressions_and_sigma(spark):
    assert [r.v for r in gradients.exponential_progression(spark, 3, 1.0, 100.0, "v").orderBy("v").collect()] == pytest.approx([1, 10, 100])
    rows = spark.createDataFrame([(0, [0.0, 1.0, 4.0, 9.0])], "i long, d2 array<double>")
    sigma = gradients.find_sigma(rows, 2.0).first().sigma
    assert sum(np.exp(-v / sigma) for v in (0, 1, 4, 9)) == pytest.approx(2, abs=0.011)


def test_idx_files(spark, tmp_path):
    images = np.random.default_rng(5).integers(0, 256, (7, 3, 2)).astype(np.uint8)
    (tmp_path / "i").write_bytes(struct.pack(">HBB3I", 0, 8, 3, 7, 3, 2) + images.tobytes())
    (tmp_path / "l").write_bytes(struct.pack(">HBBI", 0, 8, 1, 7) + bytes(range(7)))
    rows = loaders.idx_points(spark, str(tmp_path / "i"), str(tmp_path / "l")).orderBy("id").collect()
    assert [r.label for r in rows] == list(range(7)) and rows[3].x == images[3].ravel().tolist()
    assert loaders.idx_points(spark, str(tmp_path / "i")).first().label == 1
    with pytest.raises(ValueError):
        loaders.decode_idx(b"\1\2\3\4")


def test_pickled_batches_refuse_code(spark, tmp_path):
    data = {"data": np.arange(6, dtype=np.uint8).reshape(2, 3), "labels": [4, 5]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "batch_1").write_bytes(pickle.dumps(data, protocol=2))
    rows = loaders.pickled_batches(spark, str(tmp_path / "a")).orderBy("id").collect()
    assert [(r.label, r.x) for r in rows] == [(4, [0, 1, 2]), (5, [3, 4, 5])]

    class Bad:
        def __reduce__(self):
            return (print, ("run",))

    with pytest.raises(pickle.UnpicklingError):
        import io

        loaders._Arrays(io.BytesIO(pickle.dumps(Bad()))).load()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("word,a,b\nx,1,2\ny,3,4\n")
    assert sorted(r.x for r in loaders.word_vectors(spark, str(tmp_path / "w.csv")).collect()) == [[1, 2], [3, 4]]
    (tmp_path / "e.csv").write_text("gene,c1,c2,c3\ng2,1,2,3\ng1,4,5,6\n")
    (tmp_path / "m.csv").write_text("cell,kind\nc1,beta\nc2,alpha\nc9,alpha\n")
    rows = loaders.single_cell(spark, str(tmp_path / "e.csv"), str(tmp_path / "m.csv"), "kind").orderBy("id").collect()
    assert [(r.x, r.label) for r in rows] == [([4, 1], 1.0), ([5, 2], 0.0)]


def test_image_folder(spark, tmp_path):
    import zlib

    def png(pixels):
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "obj12_0.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)]]))
    row = loaders.image_folder(spark, str(tmp_path)).first()
    assert row.label == 12 and row.x == [1, 2, 3, 4, 5, 6]  # red, green, blue, as in the file


def test_generators_do_not_depend_on_partitions(spark):
    for make in (lambda: loaders.swiss_roll(spark, 60), lambda: loaders.fake_gaussian(spark, 60), lambda: loaders.fake_clusters(spark, 60)):
        held = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        found = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
            found.append({r.id: (tuple(r.x), r.label) for r in make().collect()})
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if held is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", held)
        assert found[0] == found[1] and len(found[0]) == 60
    x = np.array([r.x for r in loaders.fake_gaussian(spark, 4000, 3, seed=9).collect()])
    assert np.abs(x.mean(axis=0)).max() < 0.08 and np.abs(x.std(axis=0) - 1).max() < 0.08
    assert np.abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.08


@pytest.mark.parametrize("dim", [1, 4])
def test_dbscan_in_any_number_of_dimensions(spark, dim):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (20, dim)) for c in (0, 3)] + [np.full((1, dim), 9.0)])
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = {r.id: r.cluster for r in metrics.dbscan(spark, points, eps=0.8, min_samples=4).collect()}
    assert {got[k] for k in range(20)} == {0} and {got[k] for k in range(20, 40)} == {20} and got[40] == -1
    assert metrics.dbscan(spark, points.limit(0)).count() == 0


def test_class_distances_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metrics, "_BINS", 7)
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(70, 3)), rng.integers(0, 3, 70)
    points = spark.createDataFrame([(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label))], "id long, x array<double>, label int").repartition(3)
    z = (x - x.min()) / (x.max() - x.min()) - 0.5
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    got = {(r.a, r.b): r.distance for r in metrics.cluster_distances(points).collect()}
    for a in range(3):
        for b in range(a + 1, 3):
            own = np.sort(d[label == a][:, label == b].ravel())
            assert got[a, b] == pytest.approx(own[len(own) // 10], abs=1e-12)
    assert len(got) == 3 and metrics.cluster_distances(points.limit(0)).count() == 0


def test_dataset_registry(spark, sf):
    scaled = loaders.get_dataset(spark, "fake_clusters", 40, num_points=20, desired_dim=15)
    assert scaled.count() == 20 and len(scaled.first().x) == 15
    assert scaled.agg(F.max(F.array_max("x"))).first()[0] == pytest.approx(1, abs=0.3)
    by_path = loaders.get_dataset(spark, "parquet", f"{sf}/embeddings.parquet", vector_col="embedding", id_col="vec_id", label_col="label")
    assert by_path.count() == 500
    with pytest.raises(ValueError):
        loaders.get_dataset(spark, "none")


def test_runs_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "umap", "default", "seconds", 1.0), ("d", "blended", "default", "acc", 0.5)], runs.RUNS)
    runs.save_runs(rows, str(tmp_path / "r"))
    assert runs.read_runs(spark, str(tmp_path / "r"), ("d/umap", "default")).first().value == 1.0
    assert runs.read_runs(spark, str(tmp_path / "r"), metric="acc").count() == 1
    runs.save_positions(spark.createDataFrame([(1, [1.0, 2.0])], "id long, y array<double>"), str(tmp_path / "p"), dataset="d")
    assert spark.read.parquet(str(tmp_path / "p")).first().dataset == "d"


def test_sweep_and_algorithms(spark):
    points = loaders.fake_clusters(spark, 40, 5, seed=3)
    rows = sweep(spark, {"clusters": points}, ("umap", "blended"), ("default", "normalized"), n_epochs=10, n_neighbors=6).collect()
    assert {(r.algorithm, r.param) for r in rows} == {("umap", "default"), ("blended", "default"), ("blended", "normalized")}
    assert len(algorithm("pca")(points).first().y) == 2
    with pytest.raises(ValueError):
        algorithm("none")


def test_command_line(spark, tmp_path, capsys):
    cli.main(["--source", "fake_clusters", "--path", "30", "--n-epochs", "5", "--n-neighbors", "5", "--random-init", "--out", str(tmp_path / "o")])
    assert "30 points" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "o")).count() == 30
    assert cli.params_of(cli.arguments(["--normalized"])).amplify_grads


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("embeddings", "customer"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = db.sql(SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    for c in columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(np.sort(got[c].to_numpy(float)), np.sort(want[c].to_numpy(float)), atol=1e-5, equal_nan=True)
        else:
            assert sorted(got[c]) == sorted(want[c])


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["head", "tail", "w"] and df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("gain", [0, 10**9])
def test_dbscan_by_blocks_and_by_cells(spark, monkeypatch, gain):
    """Before, dense tables met in a join of all their pairs; distances of exactly eps count on both paths."""
    monkeypatch.setattr(metrics, "CELLS_GAIN", gain)
    monkeypatch.setattr(metrics, "paired", lambda points, f=metrics.paired: f(points, 32, 48))
    rng = np.random.default_rng(8)
    x = (rng.integers(0, 4, (400, 5)) + 7 * rng.integers(0, 5, (400, 1))) * 0.5
    near = np.zeros((400, 400))
    for k in range(5):
        near += (x[:, None, k] - x[None, :, k]) ** 2
    near = near <= 0.5
    core = near.sum(axis=1) >= 6
    label = np.where(core, np.arange(400), 400)
    for _ in range(400):
        label = np.where(core, np.where(near & core[None, :], label[None, :], 400).min(axis=1), 400)
    label = np.where(core, label, np.where(near & core[None, :], label[None, :], 400).min(axis=1))
    label = np.where(label == 400, -1, label)
    assert len(set(label[core])) > 3 and (label[~core] >= 0).any() and (label == -1).any()
    got = {r.id: r.cluster for r in metrics.dbscan(spark, points_of(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]), 0.5**0.5, 6).collect()}
    assert got == dict(enumerate(label.tolist()))
