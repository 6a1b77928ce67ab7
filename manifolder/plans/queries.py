"""A query for each operator over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.functions import forces as fm
from manifolder.functions.vector import angular_similarity, cosine_distance, euclidean, euclidean_gradient, norm, squared_distance
from manifolder.operators import gradients, graph, knn, layout, metrics, resample, spectral
from manifolder.operators.session import Scratch
from manifolder.plans.estimator import GraphLayout
from manifolder.plans.params import Params
from manifolder.plans.sweep import sweep
from manifolder.sources import loaders

K, EPOCHS = 15, 200
A, B = 1.577, 0.8951

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.embeddings(spark, sf)


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _knn(spark, sf, metric="euclidean"):
    return knn.knn_exact(_points(spark, sf), K, metric)


def _edges(spark, sf, pseudo=True, method="umap"):
    """Neighbours and edges are written once: the steps after them read both several times."""
    scratch = Scratch(spark, "edges")
    near = scratch.keep(_knn(spark, sf), "knn")
    return scratch.keep(graph.symmetrize(graph.similarities(near, graph.calibrate(near, K, pseudo_distance=pseudo), pseudo), method), "edges")


def _flat(points):
    """The first two coordinates, from 0 to 10."""
    return resample.rescale_columns(points.select("id", "label", F.slice("x", 1, 2).alias("x")))


# Neighbours


@query
def knn_euclidean(spark, sf):
    return _knn(spark, sf).select("i", "j", "rank", _r("d"))


@query
def knn_cosine(spark, sf):
    return _knn(spark, sf, "cosine").select("i", "j", "rank", _r("d"))


@query
def knn_expressions(spark, sf):
    return knn.knn_expressions(_points(spark, sf), 5).select("i", "j", "rank", _r("d"))


@query
def knn_callable(spark, sf):
    """A search of one's own: neighbours by the first coordinate alone."""

    def by_first(points, k):
        return knn.knn_line(points.select("id", F.get("x", F.lit(0)).alias("x")), k, distance_power=1.0)

    return knn.nearest_neighbors(spark, _points(spark, sf), 4, strategy=by_first).select("i", "j", "rank", _r("d"))


@query
def mutual_neighbors(spark, sf):
    return knn.mutual(_knn(spark, sf))


@query
def recall_overlap(spark, sf):
    return knn.recall(_knn(spark, sf, "cosine"), _knn(spark, sf)).select(_r("recall"))


@query
def nn_descent(spark, sf):
    return knn.knn_descent(spark, _points(spark, sf), K).select("i", "j", "rank", _r("d"))


@query
def nn_descent_recall(spark, sf):
    """Whether the search finds 98 of 100 true neighbours."""
    points = _points(spark, sf)
    return knn.recall(knn.knn_descent(spark, points, 10), knn.knn_exact(points, 10)).select((F.col("recall") >= 0.98).alias("enough"))


@query
def projection_leaves(spark, sf):
    return knn.random_projection_leaves(spark, _points(spark, sf), 4, 30)


@query
def diversified_neighbors(spark, sf):
    points = _points(spark, sf)
    return knn.diversify(knn.knn_exact(points, 6), points).select("i", "j", "rank", _r("d"))


# Graph


@query
def calibration(spark, sf):
    return graph.calibrate(_knn(spark, sf), K).select("i", _r("rho"), _r("sigma"))


@query
def calibration_plain(spark, sf):
    return graph.calibrate(_knn(spark, sf), K, pseudo_distance=False).select("i", _r("rho"), _r("sigma"))


def _similarities(spark, sf, pseudo):
    near = _knn(spark, sf)
    return graph.similarities(near, graph.calibrate(near, K, pseudo_distance=pseudo), pseudo).select("i", "j", _r("p", 5))


@query
def similarity_pseudo(spark, sf):
    return _similarities(spark, sf, True)


@query
def similarity_plain(spark, sf):
    return _similarities(spark, sf, False)


@query
def fuzzy_graph(spark, sf):
    return _edges(spark, sf).select("head", "tail", _r("w", 5))


@query
def mean_graph(spark, sf):
    return _edges(spark, sf, method="tsne").select("head", "tail", _r("w", 5))


@query
def pruned_graph(spark, sf):
    return graph.prune_edges(_edges(spark, sf), EPOCHS).select("head", "tail", _r("w", 5))


@query
def sampling_schedule(spark, sf):
    return graph.epochs_per_sample(graph.prune_edges(_edges(spark, sf), EPOCHS)).select("head", "tail", _r("epochs_per_sample", 3))


@query
def vertex_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf)).select("id", "degree", _r("weight", 4))


@query
def edge_statistics(spark, sf):
    return graph.weight_stats(_edges(spark, sf)).select("n_edges", _r("total", 2), _r("mean", 5), _r("largest", 5), _r("smallest", 5))


@query
def normalized_weights(spark, sf):
    return graph.normalize_weights(_edges(spark, sf)).select("head", "tail", _r("w", 8))


@query
def coalesced_edges(spark, sf):
    """Neighbours under both metrics as one weighted graph without its diagonal."""
    both = _knn(spark, sf).unionByName(_knn(spark, sf, "cosine")).select(F.col("i").alias("head"), F.col("j").alias("tail"), F.col("d").alias("w"))
    return graph.remove_diagonal(graph.coalesce_edges(both)).select("head", "tail", _r("w", 5))


@query
def degree_pruned_edges(spark, sf):
    edges = _knn(spark, sf).select(F.col("i").alias("head"), F.col("j").alias("tail"), F.col("d").alias("w"))
    return knn.degree_prune(edges, 8).select("head", "tail", _r("w"))


@query
def edge_offsets(spark, sf):
    return graph.offsets(_edges(spark, sf))


@query
def graph_components(spark, sf):
    """Of the graph of each point's nearest other point."""
    near = knn.knn_exact(_points(spark, sf), 2).where("i <> j").select(F.col("i").alias("head"), F.col("j").alias("tail"))
    return graph.components(spark, near, _points(spark, sf))


@query
def label_centroids(spark, sf):
    points = _points(spark, sf)
    return graph.centroids(points, points.select("id", F.col("label").alias("group"))).select("group", F.posexplode("x").alias("pos", "v")).select("group", "pos", _r("v"))


@query
def centroid_affinities(spark, sf):
    points = _points(spark, sf)
    return graph.centroid_affinity(graph.centroids(points, points.select("id", F.col("label").alias("group")))).select("a", "b", _r("affinity"))


# Scalars and forces


@query
def vector_functions(spark, sf):
    points = _points(spark, sf)
    a, b = points.select(F.col("id").alias("i"), F.col("x").alias("xi")), points.select(F.col("id").alias("j"), F.col("x").alias("xj"))
    pairs = a.join(b, F.col("j") == F.col("i") + 1)
    grad = euclidean_gradient(F.col("xi"), F.col("xj"))["grad"][0]
    columns = {"euclidean": euclidean(F.col("xi"), F.col("xj")), "cosine": cosine_distance(F.col("xi"), F.col("xj")), "angular": angular_similarity(F.col("xi"), F.col("xj")), "norm": norm(F.col("xi")), "grad_first": grad}
    return pairs.select("i", *[F.round(c, 6).alias(n) for n, c in columns.items()])


def _force_rows(spark, sf):
    flat = _flat(_points(spark, sf)).select("id", "x")
    near = _knn(spark, sf).where("i <> j").select("i", "j")
    joined = near.join(flat.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i").join(flat.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j")
    return joined.select("i", "j", squared_distance(F.col("xi"), F.col("xj")).alias("d2"))


def _forces(spark, sf, normalized, frobenius):
    ops, d2 = fm.ColumnOps, F.col("d2")
    force, q = fm.repulsion(ops, d2, 0.25, A, B, normalized, frobenius)
    attr = fm.attraction(ops, d2, F.lit(0.5), A, B, normalized, frobenius)
    return _force_rows(spark, sf).select("i", "j", F.round(attr, 6).alias("attraction"), F.round(force, 6).alias("repulsion"), F.round(q, 6).alias("q"))


@query
def forces_kl(spark, sf):
    return _forces(spark, sf, False, False)


@query
def forces_kl_normalized(spark, sf):
    return _forces(spark, sf, True, False)


@query
def forces_frobenius(spark, sf):
    return _forces(spark, sf, False, True)


@query
def forces_frobenius_normalized(spark, sf):
    return _forces(spark, sf, True, True)


def _one_epoch(spark, sf, p: Params):
    points, edges = _points(spark, sf), graph.prune_edges(_edges(spark, sf), EPOCHS)
    n = points.count()
    if p.normalized:
        edges = graph.normalize_weights(edges)
    mean = edges.agg(F.avg("w")).first()[0]
    state = _flat(points).select("id", F.col("x").alias("y"), F.array(F.lit(0.0), F.lit(0.0)).alias("u"), F.array(F.lit(1.0), F.lit(1.0)).alias("gains"))
    out = layout.epoch_frame(state, edges, p, 1, 4.0 if p.amplify_grads else 1.0, mean, lambda h, t: F.pmod(h * 31 + t * 17 + 1, F.lit(n)), p.first_rate(n))
    return out.select("id", F.round(F.col("y")[0], 5).alias("y0"), F.round(F.col("y")[1], 5).alias("y1"), F.round(F.col("gains")[0], 3).alias("gain"))


@query
def blended_epoch(spark, sf):
    return _one_epoch(spark, sf, Params(a=1.0, b=1.0, sym_attraction=True, n_epochs=EPOCHS))


@query
def blended_epoch_normalized(spark, sf):
    return _one_epoch(spark, sf, Params(a=1.0, b=1.0, normalized=True, sym_attraction=False, amplify_grads=True, n_epochs=EPOCHS))


@query
def umap_epoch(spark, sf):
    """The seventh epoch of umap from given positions: the edges whose turn it is, and their negative samples."""
    p = Params(method="umap", a=1.0, b=1.0, n_epochs=EPOCHS)
    points, edges = _points(spark, sf), graph.prune_edges(_edges(spark, sf), EPOCHS)
    n, stats = points.count(), edges.agg(F.max("w").alias("top"), F.avg("w").alias("mean")).first()
    state = _flat(points).select("id", F.col("x").alias("y"), F.array(F.lit(0.0), F.lit(0.0)).alias("u"), F.array(F.lit(1.0), F.lit(1.0)).alias("gains"))
    timed = edges.withColumn("every", F.lit(stats.top) / F.col("w"))
    partner = lambda h, t, nth: F.pmod(h * 31 + t * 17 + nth * 7 + 1, F.lit(n))
    out = layout.epoch_frame(state, timed, p, 7, 1.0, stats.mean, partner, p.first_rate(n))
    return out.select("id", F.round(F.col("y")[0], 5).alias("y0"), F.round(F.col("y")[1], 5).alias("y1"))


def _numbered(spark, y):
    return spark.createDataFrame(pa.table({"id": np.arange(len(y)), "y0": y[:, 0], "y1": y[:, 1]}))


@query
def tsne_epoch(spark, sf):
    """An epoch of t-SNE from given positions, with all pairs opened."""
    p = Params(method="tsne", a=1.0, b=1.0, normalized=True, sym_attraction=False, amplify_grads=True, n_epochs=1, theta=0.0)
    edges = graph.prune_edges(_edges(spark, sf, method="tsne"), EPOCHS)
    start = _flat(_points(spark, sf)).select("id", "x").orderBy("id").toArrow()
    return _numbered(spark, layout.optimize(spark, edges, start.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2), p)).select("id", _r("y0", 5), _r("y1", 5))


# Layouts


def _layout(spark, sf, *args, **changes):
    out = GraphLayout(*args, **changes).fit_transform(_points(spark, sf))
    return out.select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))


@query
def embed_blended(spark, sf):
    return _layout(spark, sf, "blended")


@query
def embed_blended_normalized(spark, sf):
    return _layout(spark, sf, "blended_normed")


@query
def embed_blended_frobenius(spark, sf):
    return _layout(spark, sf, frobenius=True, n_epochs=EPOCHS, a=1.0, b=1.0)


@query
def embed_umap(spark, sf):
    return _layout(spark, sf, "umap")


@query
def embed_tsne(spark, sf):
    return _layout(spark, sf, "tsne")


@query
def spectral_layout(spark, sf):
    points = _points(spark, sf)
    n = points.count()
    kept = Scratch(spark, "pruned").keep(graph.prune_edges(_edges(spark, sf), EPOCHS), "edges")
    y = np.asarray(spectral.spectral_layout(spark, kept, points, n, 2))
    return _numbered(spark, y)


# Measures


@query
def neighbor_accuracy(spark, sf):
    return metrics.knn_accuracy(_points(spark, sf)).select(_r("accuracy"))


@query
def v_measure(spark, sf):
    """Of the sign pattern of two coordinates against the labels."""
    cluster = (F.col("x")[0] > 0).cast("int") * 2 + (F.col("x")[1] > 0).cast("int")
    return metrics.v_measure(_points(spark, sf).select("label", cluster.alias("cluster"))).select(_r("homogeneity"), _r("completeness"), _r("v_measure"))


@query
def kmeans_quality(spark, sf):
    return metrics.cluster_quality(spark, _points(spark, sf), "kmeans")


@query
def dbscan_quality(spark, sf):
    found = metrics.cluster_quality(spark, _points(spark, sf), "dbscan", eps=0.9, min_samples=5)
    return found.select(_r("homogeneity"), _r("completeness"), _r("v_measure"))


@query
def spectral_clustering_quality(spark, sf):
    return metrics.cluster_quality(spark, _points(spark, sf), "spectral")


@query
def dbscan_clusters(spark, sf):
    return metrics.dbscan(spark, _flat(_points(spark, sf)).select("id", "x"), eps=0.35, min_samples=5)


@query
def class_distances(spark, sf):
    return metrics.cluster_distances(_points(spark, sf)).select("a", "b", _r("distance"))


@query
def class_distances_as_published(spark, sf):
    return metrics.cluster_distances(_points(spark, sf), as_published=True).select("a", "b", _r("distance"))


@query
def intra_inter_distance(spark, sf):
    return metrics.intra_inter(_points(spark, sf)).select(_r("intra"), _r("inter"))


@query
def principal_components(spark, sf):
    return metrics.pca(_points(spark, sf)).select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))


@query
def parameter_sweep(spark, sf):
    """All presets under all switches, by their own numbers of epochs and neighbours."""
    return sweep(spark, {"embeddings": _points(spark, sf)}, at_once=spark.sparkContext.defaultParallelism)


# Resizing


@query
def strided_sample(spark, sf):
    return resample.stride_sample(_points(spark, sf), 70).select("id", "label")


@query
def upsampled(spark, sf):
    n = _points(spark, sf).count()
    return resample.upsample(_points(spark, sf), 3 * n + 7).select("id", "label", F.round(F.col("x")[0], 6).alias("x0"))


@query
def stratified_sample(spark, sf):
    return resample.stratified_subsample(_points(spark, sf), 3, 5, [1, 4, 7]).select("id", "label")


@query
def scaled_points(spark, sf):
    return resample.scale_global(_points(spark, sf)).select("id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[63], 6).alias("x63"))


@query
def rescaled_columns(spark, sf):
    return _flat(_points(spark, sf)).select("id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


@query
def standardized_points(spark, sf):
    return metrics.standardized(_points(spark, sf)).select("id", F.round(F.col("x")[0], 6).alias("x0"))


@query
def tiled_dimensions(spark, sf):
    return resample.tile_dimensions(_points(spark, sf), 100, seed=None).select("id", F.round(F.col("x")[99], 6).alias("x99"), F.size("x").alias("dim"))


@query
def dense_numbering(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_name")
    return metrics.dense_ids(customers, "c_name")


# Generators and gradient fields


def _numbers(points, *places):
    return points.select("id", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in places], "label")


@query
def swiss_roll(spark, sf):
    return _numbers(loaders.swiss_roll(spark, 500), 0, 1, 2)


@query
def fake_gaussian(spark, sf):
    return _numbers(loaders.fake_gaussian(spark), 0, 4, 9)


@query
def fake_clusters(spark, sf):
    return _numbers(loaders.fake_clusters(spark), 0, 4, 9)


def _field(kind):
    def run(spark, sf):
        return gradients.gradient_field(spark, kind).select("x_place", "y_place", _r("x"), _r("y"), (F.round("grad", 5) + F.lit(0.0)).alias("grad"))

    return run


QUERIES |= {f"gradient_field_{kind}": _field(kind) for kind in gradients.FIELDS}


@query
def centered_kernel(spark, sf):
    return gradients.centered_kernel(_points(spark, sf), 6)


@query
def centered_gradient_field(spark, sf):
    """Over the distances of two rows of eight points on a line."""
    line = lambda step: spark.range(8).select("id", F.array(F.col("id") * F.col("id") * step + 0.01).alias("x"))
    field = gradients.centered_field(gradients.pairwise_squared(line(0.0131313)), gradients.pairwise_squared(line(0.0070707)))
    return field.select("x_place", "y_place", (F.round("grad", 6) + F.lit(0.0)).alias("grad"))


@query
def gaussian_distances(spark, sf):
    low, high = gradients.gaussian_distances(spark, 60, 10, 2)
    return high.join(low.withColumnRenamed("value", "low"), "place").select("place", F.round("low", 5).alias("low"), F.round("value", 4).alias("high"))


@query
def point_distances(spark, sf):
    return gradients.sampled_distances(_points(spark, sf), 50)[1].select("place", _r("value", 5))


@query
def entropy_sigma(spark, sf):
    near = _knn(spark, sf).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda e: F.pow(e["d"], F.lit(4.0))).alias("d2"))
    return gradients.find_sigma(near, float(np.log2(K))).select("i", _r("sigma", 5))
