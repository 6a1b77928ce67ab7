"""The force model, once as formulas that hold for Columns and NumPy arrays alike.

``ops`` supplies what differs between the two: a power, and a choice.  d2 is
the squared low-dimensional distance, q the kernel, w an edge weight.  At
d2 = 0 attraction has no direction and is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class ColumnOps:
    power = staticmethod(lambda x, y: F.pow(x, F.lit(float(y))))
    choose = staticmethod(lambda when, a, b: F.when(when, a).otherwise(b))
    value = staticmethod(lambda x: F.lit(float(x)))
    floor = staticmethod(F.floor)
    ceil = staticmethod(F.ceil)
    most = staticmethod(lambda x, y: F.greatest(x, F.lit(y).cast("long")))


class ArrayOps:
    @staticmethod
    def power(x, y):
        if y == 1:
            return x
        if y == 0:
            return np.ones_like(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.power(x, y)

    choose = staticmethod(np.where)
    value = staticmethod(float)
    floor = staticmethod(np.floor)
    ceil = staticmethod(np.ceil)
    most = staticmethod(np.maximum)


def kernel(ops, d2, a: float, b: float):
    """1 / (1 + a d2^b), times d2^(b - 1) where b > 1."""
    base = 1.0 / (1.0 + ops.power(d2, b) * a)
    return base * ops.power(d2, b - 1) if b > 1 else base


def umap_attraction(ops, d2, a: float, b: float):
    return ops.choose(d2 > 0, ops.power(ops.choose(d2 > 0, d2, ops.value(1)), b - 1) * (2.0 * a * b) / (ops.power(d2, b) * a + 1.0), ops.value(0))


def umap_repulsion(ops, d2, a: float, b: float):
    return (2.0 * b) / ((d2 + 0.001) * (ops.power(d2, b) * a + 1.0))


def attraction(ops, d2, w, a: float, b: float, normalized: bool, frobenius: bool):
    """Force along an edge of weight ``w``."""
    if frobenius:
        q = kernel(ops, d2, a, b)
        return w * (q * q + q * q * q * 2.0) if normalized else w * q * q
    return w * (kernel(ops, d2, a, b) if normalized else umap_attraction(ops, d2, a, b))


def repulsion(ops, d2, mean_weight: float, a: float, b: float, normalized: bool, frobenius: bool, cell_size=1.0):
    """(force, q) away from a point, or from a cell of ``cell_size`` points; q counts for normalized layouts."""
    if frobenius:
        q = kernel(ops, d2, a, b)
        force = q * q * q + q * q * q * q * 2.0 if normalized else q * q * q
    else:
        q = kernel(ops, d2, a, b) if normalized else umap_repulsion(ops, d2, a, b)
        force = q * q if normalized else q * (1.0 - mean_weight)
    return force * cell_size, q * cell_size


def learning_rate(first: float, epoch: int, epochs: int, amplify: bool) -> float:
    return first if amplify else first * (1.0 - epoch / epochs)
