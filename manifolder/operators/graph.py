"""From neighbour lists to a weighted, symmetric similarity graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifolder.operators.session import Scratch


def _bisect(d: np.ndarray, sizes: np.ndarray, k: int, steps: int, pseudo: bool, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma of rows of sorted distances (padded to the widest row)."""
    n, wide = d.shape
    target = np.log2(k)
    inside = np.arange(wide)[None, :] < sizes[:, None]
    positive = np.where(inside & (d > 0), d, np.inf)
    rho = positive.min(axis=1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    t = d - rho[:, None] if pseudo else d
    low, high, middle = np.zeros(n), np.full(n, np.inf), np.ones(n)
    live = np.ones(n, bool)
    for _ in range(steps):
        total = np.zeros(n)
        for column in range(1, wide):
            with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                term = np.where(t[:, column] > 0, np.exp(-t[:, column] / middle), 1.0)
            total += np.where(inside[:, column], term, 0.0)
        live &= np.abs(total - target) >= tolerance
        if not live.any():
            break
        above = total > target
        high = np.where(live & above, middle, high)
        low = np.where(live & ~above, middle, low)
        following = np.where(np.isinf(high), middle * 2, (low + high) / 2)
        middle = np.where(live, following, middle)
    return rho, middle


def calibrate(knn: DataFrame, k: int, steps: int = 64, pseudo_distance: bool = True, tolerance: float = 1e-5, sigma_floor: float | None = None) -> DataFrame:
    """(i, rho, sigma): rho is the first positive distance, sigma meets log2(k) by bisection.

    ``sigma_floor`` bounds sigma from below by that multiple of the mean
    distance of the point where rho is positive.
    """
    rows = knn.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda e: e["d"]).alias("d"))

    @F.pandas_udf("rho double, sigma double")
    def solve(lists: pd.Series) -> pd.DataFrame:
        sizes = lists.map(len).to_numpy()
        d = np.zeros((len(lists), sizes.max() if len(sizes) else 0))
        for row, values in enumerate(lists):
            d[row, : len(values)] = values
        rho, sigma = _bisect(d, sizes, k, steps, pseudo_distance, tolerance)
        if sigma_floor is not None:
            least = sigma_floor * d.sum(axis=1) / np.maximum(sizes, 1)
            sigma = np.where(rho > 0, np.maximum(sigma, least), sigma)
        return pd.DataFrame({"rho": rho, "sigma": sigma})

    return rows.select("i", solve("d").alias("c")).select("i", "c.rho", "c.sigma")


def similarities(knn: DataFrame, calibration: DataFrame, pseudo_distance: bool = True) -> DataFrame:
    """(i, j, p): directed similarity; 1 within rho whether or not rho is subtracted, none to oneself."""
    joined = knn.where("i <> j").join(calibration, "i")
    distance = F.col("d") - F.col("rho") if pseudo_distance else F.col("d")
    p = F.when((F.col("d") - F.col("rho") <= 0) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-distance / F.col("sigma")))
    return joined.select("i", "j", p.alias("p")).where("p <> 0")


def symmetrize(sim: DataFrame, method: str = "umap") -> DataFrame:
    """(head, tail, w), both directions: p + q - pq (umap) or (p + q) / 2 (tsne); a missing direction is 0."""
    back = sim.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("q"))
    both = sim.join(back, ["i", "j"], "full_outer").select("i", "j", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    if method not in ("umap", "tsne"):
        raise ValueError(f"unknown symmetrization {method}")
    w = F.col("p") + F.col("q") - F.col("p") * F.col("q") if method == "umap" else (F.col("p") + F.col("q")) / 2
    return both.select(F.col("i").alias("head"), F.col("j").alias("tail"), w.alias("w")).where("w <> 0")


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges summed, zero weights dropped."""
    return edges.groupBy("head", "tail").agg(F.sum("w").alias("w")).where("w <> 0")


def remove_diagonal(edges: DataFrame) -> DataFrame:
    return edges.where("head <> tail")


def _with(edges: DataFrame, *aggregates) -> DataFrame:
    """Edges beside one row of aggregates over all of them."""
    return edges.crossJoin(F.broadcast(edges.agg(*aggregates)))


def prune_edges(edges: DataFrame, n_epochs: int) -> DataFrame:
    """Edges of at least the largest weight over the number of epochs."""
    return _with(edges, F.max("w").alias("top")).where(F.col("w") >= F.col("top") / n_epochs).drop("top")


def epochs_per_sample(edges: DataFrame) -> DataFrame:
    """(head, tail, epochs_per_sample): largest weight over weight; -1 for weights that aren't positive."""
    return _with(edges, F.max("w").alias("top")).select("head", "tail", F.when(F.col("w") > 0, F.col("top") / F.col("w")).otherwise(-1.0).alias("epochs_per_sample"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weight): edges into each vertex that has any, and their weight."""
    return edges.groupBy(F.col("tail").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))


def weight_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.sum("w").alias("total"), F.avg("w").alias("mean"), F.max("w").alias("largest"), F.min("w").alias("smallest"))


def normalize_weights(edges: DataFrame) -> DataFrame:
    return _with(edges, F.sum("w").alias("total")).select("head", "tail", (F.col("w") / F.col("total")).alias("w"))


def offsets(edges: DataFrame) -> DataFrame:
    """(head, degree, first): where a head's edges begin in head order, by a running sum over blocks of heads."""
    counts = edges.groupBy("head").agg(F.count("*").alias("degree")).withColumn("block", F.floor(F.col("head") / 65_536))
    blocks = counts.groupBy("block").agg(F.sum("degree").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("inner", F.coalesce(F.sum("degree").over(inside), F.lit(0)))
    return running.join(base, "block").select("head", "degree", (F.col("inner") + F.col("base")).alias("first"))


def _edge_state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest vertex reachable; ``vertices`` (id) adds those without edges.

    Alternates large and small stars: every vertex hands its larger
    neighbours, then its smaller ones, to the smallest it knows.  A round is
    two aggregations and two joins over edges that only get fewer, and ends in
    a table of the shared folder; nothing but a checksum comes to the driver.
    """
    scratch = Scratch(spark, "components")
    ends = edges.where("head <> tail").select(F.greatest("head", "tail").alias("u"), F.least("head", "tail").alias("v"))
    stars = scratch.keep(ends.distinct(), "round0")
    before = _edge_state(stars)
    for turn in range(1, rounds + 1):
        if not before[0]:
            break
        around = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        stars = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"round{turn}")
        scratch.drop(f"round{turn - 1}")
        after = _edge_state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    linked = stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    alone = edges.select(F.explode(F.array("head", "tail")).alias("id"))
    if vertices is not None:
        alone = alone.unionByName(vertices.select("id"))
    return alone.distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def centroids(points: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, x): the mean vector of each group; ``groups`` is (id, group)."""
    each = points.join(groups, "id").select("group", F.posexplode("x").alias("pos", "v"))
    means = each.groupBy("group", "pos").agg(F.avg("v").alias("m"))
    return means.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("x"))


def centroid_affinity(centers: DataFrame) -> DataFrame:
    """(a, b, affinity): exp(-squared distance) of every pair of group centres."""
    from manifolder.functions.vector import squared_distance

    a, b = centers.select(F.col("group").alias("a"), F.col("x").alias("xa")), centers.select(F.col("group").alias("b"), F.col("x").alias("xb"))
    return a.crossJoin(b).select("a", "b", F.exp(-squared_distance(F.col("xa"), F.col("xb"))).alias("affinity"))


def fuzzy_graph(spark: SparkSession, points: DataFrame, k: int = 15, metric: str = "euclidean", pseudo_distance: bool = True, method: str = "umap", **options) -> DataFrame:
    """Neighbours, calibration, similarity and symmetrization in one: (head, tail, w)."""
    from manifolder.operators.knn import nearest_neighbors

    knn = Scratch(spark, "fuzzy").keep(nearest_neighbors(spark, points, k, metric, **options), "knn")
    return symmetrize(similarities(knn, calibrate(knn, k, pseudo_distance=pseudo_distance), pseudo_distance), method)
