"""Distances and vector helpers as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def squared_distance(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def inner_product(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine; two zero vectors are at 0, a zero vector and another at 1."""
    xx, yy = inner_product(x, x), inner_product(y, y)
    apart = F.when((xx == 0) & (yy == 0), 0.0).when((xx == 0) | (yy == 0), 1.0)
    return apart.otherwise(1.0 - inner_product(x, y) / F.sqrt(xx * yy))


def euclidean_gradient(x: Column, y: Column) -> Column:
    """(distance, direction): direction is the difference over distance plus 1e-6."""
    d = euclidean(x, y)
    return F.struct(d.alias("d"), F.zip_with(x, y, lambda a, b: a - b).alias("diff")).withField("grad", F.transform(F.zip_with(x, y, lambda a, b: a - b), lambda v: v / (d + 1e-6))).dropFields("diff")


def norm(x: Column) -> Column:
    return F.sqrt(inner_product(x, x))


def angular_similarity(x: Column, y: Column) -> Column:
    """Cosine; 1 if a squared norm is below 1e-4."""
    xx, yy = inner_product(x, x), inner_product(y, y)
    return F.when((xx < 1e-4) | (yy < 1e-4), 1.0).otherwise(inner_product(x, y) / F.sqrt(xx * yy))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


METRICS = {"euclidean": euclidean, "cosine": cosine_distance}
