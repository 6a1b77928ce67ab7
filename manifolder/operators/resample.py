"""Resizing and rescaling of point sets (id, x[, label]); ids are dense from 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scale_global(points: DataFrame) -> DataFrame:
    """x divided by the largest value of all."""
    top = points.agg(F.max(F.array_max("x")).alias("top"))
    return points.crossJoin(F.broadcast(top)).withColumn("x", F.transform("x", lambda v: v / F.col("top"))).drop("top")


def rescale_columns(points: DataFrame, to: float = 10.0) -> DataFrame:
    """Each column from 0, then all by one scale so that the largest value is ``to``."""
    lows = points.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    one = lows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "low"))), lambda e: e["low"]).alias("lows"), F.max(F.col("high") - F.col("low")).alias("top"))
    return points.crossJoin(F.broadcast(one)).withColumn("x", F.transform(F.zip_with("x", "lows", lambda v, m: v - m), lambda v: v / (F.col("top") / to))).drop("lows", "top")


def upsample(points: DataFrame, target: int) -> DataFrame:
    """The set and copies of it, doubled in value and in number each time, up to ``target`` rows in order of ids.

    Row number q of the result comes from row q modulo n of the set; how often
    its value was doubled is the number of ones in q div n, as every doubling
    of the set copies, doubled, what was there before.
    """
    n = points.count()
    if not n or n >= target:
        return points
    copies = -(-target // n)
    many = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("id", F.col("id") + F.col("copy") * n).where(F.col("id") < target)
    return many.withColumn("x", F.transform("x", lambda v: v * F.pow(F.lit(2.0), F.bit_count(F.col("copy"))))).drop("copy")


def stride_sample(points: DataFrame, target: int) -> DataFrame:
    """Every row whose place divides by n // target; more than ``target`` rows where n is no multiple."""
    n = points.count()
    if n < target:
        points, n = upsample(points, target), target
    return points.where(F.pmod("id", F.lit(max(1, n // target))) == 0)


def tile_dimensions(points: DataFrame, dim: int, seed: int | None = 0) -> DataFrame:
    """Columns repeated until there are ``dim``, in an order drawn once (as they are without a seed)."""
    first = points.select("x").first()
    wide = len(first.x) if first else 1
    places = np.arange(wide * max(1, -(-dim // wide))) % wide
    if seed is not None:
        places = np.random.default_rng(seed).permutation(places)
    return points.withColumn("x", F.array(*[F.col("x")[int(p)] for p in places[:dim]]))


def stratified_subsample(points: DataFrame, num_classes: int, per_class: int, classes: list | None = None, seed: int = 0) -> DataFrame:
    """Up to ``per_class`` rows, at even strides, of each of ``num_classes`` classes.

    Classes are ``classes`` or the first in hash order; each is cut to the size
    of the smallest one chosen first.
    """
    counts = points.groupBy("label").agg(F.count("*").alias("n"))
    if classes is not None:
        chosen = counts.where(F.col("label").isin(classes))
    else:
        chosen = counts.orderBy(F.xxhash64(F.lit(seed), "label"), "label").limit(num_classes)
    found = chosen.agg(F.count("*"), F.min("n")).first()
    if found[0] < num_classes:
        raise ValueError(f"{num_classes} classes are asked for; there are {found[0]}")
    stride = max(1, found[1] // per_class)
    rows = points.join(F.broadcast(chosen.select("label")), "label", "left_semi")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1)
    return ranked.where((F.col("r") < found[1]) & (F.pmod("r", F.lit(stride)) == 0) & (F.floor(F.col("r") / stride) < per_class)).drop("r")


def sample_without_replacement(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
