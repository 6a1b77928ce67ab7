"""How good a layout is: neighbour accuracy, clusterings and distances between classes."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifolder.functions.vector import squared_distance
from manifolder.operators.blocks import distances, least_squared, opened, packed, paired, rounding, squares, unpacked
from manifolder.operators.graph import components
from manifolder.operators.knn import knn_exact
from manifolder.operators.session import Scratch


def dense_ids(df: DataFrame, key: str, name: str = "nth", block: int = 65_536) -> DataFrame:
    """``df`` with rows numbered from 0 in order of ``key``.

    Ranges of the key are counted first and numbered within, so no task sorts
    all rows.
    """
    scratch = Scratch(df.sparkSession, "numbers")  # written, so that a row stays in its range whatever is run again
    dealt = scratch.keep(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    base = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_inner", inner).join(F.broadcast(base), "_part").withColumn(name, (F.col("_inner") + F.col("_base")).cast("long")).drop("_part", "_inner", "_base")


def knn_accuracy(points: DataFrame, k: int = 100, folds: int = 10) -> DataFrame:
    """(accuracy) of a k-nearest-neighbour vote for ``points`` (id, x, label), id dense from 0.

    The test folds are contiguous runs of n // ``folds`` points, all but the
    last; each point of one is judged by its k nearest outside of it; ties of
    the vote go to the smaller label.  The result is the mean over folds.
    """
    n = points.count()
    size = max(1, n // folds)
    near = knn_exact(points.select("id", "x"), k, distance_power=1.0, apart=size).withColumn("fold", F.floor(F.col("i") / size)).where(F.col("fold") < folds - 1)
    near = near.join(points.select(F.col("id").alias("i"), F.col("label").alias("own")), "i").join(points.select(F.col("id").alias("j"), "label"), "j")
    votes = near.groupBy("i", "fold", "own", "label").count()
    best = votes.groupBy("i", "fold", "own").agg(F.min(F.struct((-F.col("count")).alias("n"), "label")).alias("b"))
    each = best.groupBy("fold").agg(F.avg((F.col("b.label") == F.col("own")).cast("double")).alias("a"))
    return each.agg(F.avg("a").alias("accuracy"))


def v_measure(assigned: DataFrame, beta: float = 1.0) -> DataFrame:
    """(homogeneity, completeness, v_measure) of ``assigned`` (label, cluster), from the contingency table."""
    cells = assigned.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("t"))
    rows = cells.withColumn("l", F.sum("n").over(Window.partitionBy("label"))).withColumn("c", F.sum("n").over(Window.partitionBy("cluster"))).crossJoin(F.broadcast(total))
    share = F.col("n") / F.col("t")
    sums = rows.agg(
        F.sum(-share * F.log(F.col("n") / F.col("c"))).alias("label_given_cluster"),
        F.sum(-share * F.log(F.col("n") / F.col("l"))).alias("cluster_given_label"),
        F.sum(-share * F.log(F.col("l") / F.col("t"))).alias("labels"),
        F.sum(-share * F.log(F.col("c") / F.col("t"))).alias("clusters"),
    )
    h = F.when(F.col("labels") == 0, 1.0).otherwise(1 - F.col("label_given_cluster") / F.col("labels"))
    c = F.when(F.col("clusters") == 0, 1.0).otherwise(1 - F.col("cluster_given_label") / F.col("clusters"))
    return sums.select(h.alias("homogeneity"), c.alias("completeness")).withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise((1 + beta) * F.col("homogeneity") * F.col("completeness") / (beta * F.col("homogeneity") + F.col("completeness"))))


#: How many pairs of blocks are measured in the time of one pair of a join.
CELLS_GAIN = 200


def _within(x: np.ndarray, y: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs at a squared distance of at most ``square``, summed in order of the dimensions where rounding could matter."""
    least = least_squared(x, y)
    i, j = np.nonzero(least <= square)
    over = 4 * rounding(x.shape[1]) * (squares(x)[i] + squares(y)[j])
    unsure = np.flatnonzero(~(least[i, j] + over < square))
    total, a, b = np.zeros(len(unsure)), x[i[unsure]], y[j[unsure]]
    for k in range(x.shape[1]):
        step = a[:, k] - b[:, k]
        total += step * step
    keep = np.ones(len(i), bool)
    keep[unsure] = total <= square
    return i[keep], j[keep]


def _smallest_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the places 0 .. n - 1 that each one reaches along the links u - v."""
    least = np.arange(n)
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    return least


def _dbscan_by_blocks(spark: SparkSession, points: DataFrame, eps: float, min_samples: int, scratch: Scratch) -> DataFrame:
    """:func:`dbscan` over pairs of blocks.

    Pairs within reach are counted first.  Then a pair of blocks gives the
    links of each of its core points to the smallest one reached within the
    two, and those of each border point to one core point of every such
    cluster, so no pair is a row.
    """
    vectors = points.select("id", F.col("x").cast("array<double>").alias("x"))

    def counted(batches):
        for ids, x, other, y in opened(batches):
            n = sum((np.bincount(_within(x[at : at + 256], y, eps * eps)[0] + at, minlength=len(ids)) for at in range(0, len(ids), 256)), np.zeros(len(ids), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["i", "n"])

    core = paired(vectors).mapInArrow(counted, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
    core = scratch.keep(core.select(F.col("i").alias("core")), "core")
    flagged = vectors.join(core, F.col("id") == F.col("core"), "left").select("id", F.concat(F.array(F.col("core").isNotNull().cast("double")), F.col("x")).alias("x"))
    flagged = scratch.keep(flagged, "flagged")

    def linked(batches):
        for ids, x, other, y in opened(batches):
            every, place = np.unique(np.concatenate([ids, other]), return_inverse=True)
            cores = np.zeros(len(every), bool)
            cores[place] = np.concatenate([x[:, 0], y[:, 0]]) > 0
            left, right = place[: len(ids)], np.flatnonzero(y[:, 0] > 0)
            least, outer = np.arange(len(every)), []
            for at in range(0, len(ids), 256):
                i, j = _within(x[at : at + 256, 1:], y[right, 1:], eps * eps)
                u, v = left[i + at], place[len(ids) + right[j]]
                inner = cores[u]
                a, b = np.append(u[inner], np.arange(len(every))), np.append(v[inner], least)
                least = _smallest_linked(a, b, len(every))
                outer.append((u[~inner], v[~inner]))
            own = np.flatnonzero(cores & (least != np.arange(len(every))))
            u, v = (np.concatenate(c) for c in zip(*outer))
            ends = np.unique(u * len(every) + least[v])
            head, tail = np.concatenate([own, ends // len(every)]), np.concatenate([least[own], ends % len(every)])
            yield pa.RecordBatch.from_arrays([pa.array(every[head]), pa.array(every[tail]), pa.array(cores[head])], names=["head", "tail", "inner"])

    links = scratch.keep(paired(flagged).mapInArrow(linked, "head long, tail long, inner boolean").distinct(), "links")
    found = scratch.keep(components(spark, links.where("inner").select("head", "tail"), core.select(F.col("core").alias("id"))), "found")
    border = links.where("not inner").join(found, links["tail"] == found["id"]).groupBy("head").agg(F.min("component").alias("reached"))
    joined = points.select("id").join(found, "id", "left").join(border.withColumnRenamed("head", "id"), "id", "left")
    return joined.select("id", F.coalesce("component", "reached", F.lit(-1)).alias("cluster"))


def dbscan(spark: SparkSession, points: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, cluster) of ``points`` (id, x): clusters of core points within ``eps``; noise is -1.

    Points meet in the cells, of side ``eps`` on the up to three coordinates
    that spread most, around their own, or, where these hold more than
    1/``CELLS_GAIN`` of all pairs, by blocks; a border point joins the smallest
    cluster in reach.  No points give no rows.
    """
    scratch = Scratch(spark, "dbscan")
    ends = points.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg((F.max("v") - F.min("v")).alias("spread"))
    wide = [r.k for r in ends.orderBy(F.desc("spread"), "k").limit(3).collect()]
    if not wide:
        return points.select("id", F.lit(-1).cast("long").alias("cluster"))
    own = points.select("id", "x", F.array(*[F.floor(F.col("x")[k] / eps) for k in wide]).alias("cell"))
    around = F.array(*[F.array(*[F.col("cell")[k] + step for k, step in enumerate(steps)]) for steps in product((-1, 0, 1), repeat=len(wide))])
    sizes = own.groupBy("cell").count()
    met = sizes.select("count", F.explode(around).alias("cell")).join(sizes.withColumnRenamed("count", "own"), "cell").agg(F.sum(F.col("count") * F.col("own"))).first()[0] or 0
    if met * CELLS_GAIN > points.count() ** 2:
        return _dbscan_by_blocks(spark, points, eps, min_samples, scratch)
    other = own.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.explode(around).alias("cell"))
    near = own.join(other, "cell").where(squared_distance(F.col("x"), F.col("xj")) <= eps * eps)
    near = scratch.keep(near.select(F.col("id").alias("i"), "j"), "near")
    core = near.groupBy("i").count().where(F.col("count") >= min_samples).select(F.col("i").alias("core"))
    links = near.join(core, near["i"] == core["core"], "left_semi").join(core.withColumnRenamed("core", "c2"), F.col("j") == F.col("c2"), "left_semi")
    found = components(spark, links.select(F.col("i").alias("head"), F.col("j").alias("tail")), core.select(F.col("core").alias("id")))
    border = near.join(found, near["j"] == found["id"]).groupBy("i").agg(F.min("component").alias("reached"))
    joined = points.select("id").join(found, "id", "left").join(border.withColumnRenamed("i", "id"), "id", "left")
    return joined.select("id", F.coalesce("component", "reached", F.lit(-1)).alias("cluster"))


def clustered(spark: SparkSession, points: DataFrame, model: str = "kmeans", seed: int = 0, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(id, label, cluster) of ``points`` (id, x, label); noise of dbscan is left out."""
    if model == "dbscan":
        found = dbscan(spark, points, eps, min_samples).where("cluster >= 0")
        return points.select("id", "label").join(found, "id")
    k = points.select("label").distinct().count()
    if model == "kmeans":
        fitted = KMeans(k=max(2, k), seed=seed, featuresCol="f", predictionCol="cluster").fit(points.withColumn("f", array_to_vector("x")))
        return fitted.transform(points.withColumn("f", array_to_vector("x"))).select("id", "label", F.col("cluster").cast("long").alias("cluster"))
    if model == "spectral":
        knn = knn_exact(points.select("id", "x"), 11, distance_power=1.0).where("i <> j")
        sims = knn.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.exp(-F.col("d")).alias("weight")).distinct()
        found = PowerIterationClustering(k=max(2, k), maxIter=20, initMode="degree", weightCol="weight").assignClusters(sims)
        return points.select("id", "label").join(found.select("id", F.col("cluster").cast("long").alias("cluster")), "id")
    raise ValueError(f"unknown cluster model {model}")


def cluster_quality(spark: SparkSession, points: DataFrame, model: str = "kmeans", **options) -> DataFrame:
    return v_measure(clustered(spark, points, model, **options).select("label", "cluster"))


def standardized(points: DataFrame) -> DataFrame:
    """x within [-0.5, 0.5] by the smallest and largest value of all."""
    ends = points.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    return points.crossJoin(F.broadcast(ends)).withColumn("x", F.transform("x", lambda v: (v - F.col("low")) / (F.col("high") - F.col("low")) - 0.5)).drop("low", "high")


def _block_pairs(points: DataFrame, run, schema: str, rows: int = 512) -> DataFrame:
    """``run`` over (ids, x, labels) of every pair of blocks of points, each unordered pair once."""

    def labelled(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = unpacked(row)
                yield ids, x[:, 1:], x[:, 0]

    def pairs(batches):
        for batch in batches:
            left = pa.RecordBatch.from_arrays(batch.columns[:3], names=["ids", "data", "wide"])
            right = pa.RecordBatch.from_arrays(batch.columns[3:], names=["ids", "data", "wide"])
            for a, b in zip(labelled([left]), labelled([right])):
                yield from run(a, b)

    table = points.select("id", F.concat(F.array(F.col("label").cast("double")), F.col("x")).alias("x"))
    return packed(table, rows).crossJoin(packed(table, rows, "b_")).mapInArrow(pairs, schema)


def _class_pairs(a, b, as_published: bool):
    """(class, class, distances) of a pair of blocks: of points of different classes, smaller first, or of the same one."""
    (_, x, lx), (_, y, ly) = a, b
    for u in np.unique(lx):
        for v in np.unique(ly):
            if u == v if as_published else u < v:
                yield u, v, distances(x[lx == u], y[ly == v], "euclidean").ravel()


_BINS = 4096


def cluster_distances(points: DataFrame, as_published: bool = False) -> DataFrame:
    """(a, b, distance): the tenth-percentile distance between classes a < b, after standardizing.

    The value is the one in place n // 10 of the sorted n distances.  With
    ``as_published`` class a is measured against itself, zeros included.
    Pairs of blocks count their distances in bins; a second pass over pairs
    gives those of the one bin where the place lies, and nothing else is sorted.
    """
    p = standardized(points).select("id", "x", "label")
    wide = p.agg(F.max(F.size("x"))).first()[0]
    if wide is None:
        return points.select(F.col("label").alias("a"), F.col("label").alias("b"), F.lit(0.0).alias("distance"))
    width = max(float(np.sqrt(wide)), 1e-300) * (1 + 1e-9) / _BINS  # coordinates are within one of each other

    def counted(a, b):
        for u, v, d in _class_pairs(a, b, as_published):
            n = np.bincount((d / width).astype(np.int64), minlength=_BINS)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), u)), pa.array(np.full(len(some), v)), pa.array(some), pa.array(n[some])], names=["a", "b", "bin", "n"])

    bins = _block_pairs(p, counted, "a double, b double, bin long, n long").groupBy("a", "b", "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("a", "b").orderBy("bin")
    placed = bins.withColumn("total", F.sum("n").over(Window.partitionBy("a", "b"))).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.floor(F.col("total") / 10)
    rows = placed.where((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select("a", "b", "bin", (place - F.col("before")).alias("place")).collect()
    wanted = {(r.a, r.b): r.bin for r in rows}  # a row for each pair of classes

    def picked(a, b):
        for u, v, d in _class_pairs(a, b, as_published):
            own = d[(d / width).astype(np.int64) == wanted[u, v]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), u)), pa.array(np.full(len(own), v)), pa.array(own)], names=["a", "b", "distance"])

    spark = points.sparkSession
    places = spark.createDataFrame([(r.a, r.b, r.place) for r in rows], "a double, b double, place long")
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("distance")) - 1
    found = _block_pairs(p, picked, "a double, b double, distance double").withColumn("nth", nth).join(F.broadcast(places), ["a", "b"]).where("nth = place")
    kind = points.schema["label"].dataType
    found = found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "distance")
    if not as_published:
        return found
    labels = points.select(F.col("label").alias("l")).distinct()
    return found.select("a", "distance").join(labels, F.col("a") < F.col("l")).select("a", F.col("l").alias("b"), "distance")


def intra_inter(points: DataFrame) -> DataFrame:
    """(intra, inter): mean distance of pairs of equal and of different labels; sums leave each pair of blocks."""

    def sums(a, b):
        (i, x, lx), (j, y, ly) = a, b
        d, later = distances(x, y, "euclidean"), i[:, None] < j[None, :]
        same = (lx[:, None] == ly[None, :]) & later
        cells = [(k, float(d[of].sum()), int(of.sum())) for k, of in ((True, same), (False, later & ~same))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["same", "total", "n"])

    each = _block_pairs(points.select("id", "x", "label"), sums, "same boolean, total double, n long").where("n > 0")
    mean = lambda of: F.sum(F.when(of, F.col("total"))) / F.sum(F.when(of, F.col("n")))
    return each.agg(mean(F.col("same")).alias("intra"), mean(~F.col("same")).alias("inter"))


def pca(points: DataFrame, dim: int = 2) -> DataFrame:
    """(id, y): principal component scores from one pass of sums and products; signs by the largest loading."""

    def moments(batches):
        n, s, ss = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                m = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                n, s, ss = n + len(m), s + m.sum(axis=0), ss + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    parts = points.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(moments, "n long, s array<double>, ss array<double>").toArrow()
    if not parts.num_rows:
        return points.select("id", F.col("x").alias("y"))
    n = sum(parts.column("n").to_pylist())
    mean, products = (sum(np.array(v) for v in parts.column(name).to_pylist()) / n for name in ("s", "ss"))
    _, vectors = np.linalg.eigh(products.reshape(len(mean), -1) - np.outer(mean, mean))
    top = vectors[:, ::-1][:, :dim]
    top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1.0, 1.0)
    lit = [F.array(*[F.lit(float(v)) for v in top[:, k]]) for k in range(top.shape[1])]
    center = F.array(*[F.lit(float(v)) for v in mean])
    scores = [F.aggregate(F.zip_with(F.zip_with("x", center, lambda a, m: a - m), loading, lambda a, v: a * v), F.lit(0.0), lambda t, v: t + v) for loading in lit]
    return points.select("id", F.array(*scores).alias("y"))
