"""Rows as blocks: vectors packed into binary matrices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(points: DataFrame, rows: int, prefix: str = "") -> DataFrame:
    """(ids, data, wide): blocks of up to ``rows`` rows of (id, x) from one partition."""
    names = [f"{prefix}{n}" for n in ("ids", "data", "wide")]

    def block(ids, vectors):
        matrix = np.array(vectors, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], names=names)

    def run(batches):
        ids, vectors = [], []
        for batch in batches:
            wide = len(batch.column(1)[0]) if batch.num_rows else 0
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, wide)
            for a in range(0, batch.num_rows, rows):
                part = flat[a : a + rows]
                if ids and len(ids) + len(part) > rows:
                    yield block(ids, np.concatenate(vectors))
                    ids, vectors = [], []
                ids += batch.column(0)[a : a + rows].to_pylist()
                vectors.append(part)
        if ids:
            yield block(ids, np.concatenate(vectors))

    return points.select(F.col("id").cast("long"), F.col("x").cast("array<double>")).mapInArrow(run, f"{names[0]} binary, {names[1]} binary, {names[2]} int")


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
    return ids, np.frombuffer(row[f"{prefix}data"], np.float64).reshape(len(ids), row[f"{prefix}wide"])


def paired(points: DataFrame, rows: int = 1024, other_rows: int = 2048) -> DataFrame:
    """(ids, data, wide, b_ids, b_data, b_wide): every block beside every block, dealt over all tasks whatever the files are.

    All blocks that a task has for one left block follow each other.  Few tasks
    share a left block: each of them has its own lists for it.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    left, right = packed(points, rows).repartition(2 * cores), packed(points, other_rows, "b_").repartition(max(2, cores // 8))
    return left.crossJoin(right)


def opened(batches):
    """(ids, x, ids, x) of each row of :func:`paired`; the left arrays stay the same objects while the block is the same."""
    held = ids = x = None
    for batch in batches:
        for r in range(batch.num_rows):
            left = (batch.column(0)[r].as_buffer(), batch.column(1)[r].as_buffer())
            if held is None or not (held[0].equals(left[0]) and held[1].equals(left[1])):
                held = tuple(pa.py_buffer(b.to_pybytes()) for b in left)
                ids = np.frombuffer(held[0], "<i8")
                x = np.frombuffer(held[1], np.float64).reshape(len(ids), batch.column(2)[r].as_py())
            other = np.frombuffer(batch.column(3)[r].as_buffer(), "<i8")
            yield ids, x, other, np.frombuffer(batch.column(4)[r].as_buffer(), np.float64).reshape(len(other), batch.column(5)[r].as_py())


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def rounding(wide: int, kind=np.float64) -> float:
    """What a squared distance from products may be off by, as a share of the two squared lengths."""
    return 4 * (wide + 8) * float(np.finfo(kind).eps)


def least_squared(a: np.ndarray, b: np.ndarray, kind=np.float64) -> np.ndarray:
    """Squared distances by a matrix product, less all that rounding may have added: never above those of :func:`distances`."""
    keep = 1 - rounding(a.shape[1], kind)
    left = np.concatenate([a * -2.0, (squares(a) * keep)[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([b, np.ones((len(b), 1)), (squares(b) * keep)[:, None]], axis=1)
    return left.astype(kind) @ right.astype(kind).T


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """:func:`distances` of the rows of two matrices of equal length, one by one: the same doubles."""
    total = np.zeros(len(a))
    if metric == "euclidean":
        for k in range(a.shape[1]):
            step = a[:, k] - b[:, k]
            total += step * step
        return np.sqrt(total)
    aa, bb = np.zeros(len(a)), np.zeros(len(b))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - total / np.sqrt(aa * bb)
    return np.where((aa == 0) & (bb == 0), 0.0, np.where((aa == 0) | (bb == 0), 1.0, out))


def distances(a: np.ndarray, b: np.ndarray, metric) -> np.ndarray:
    """Pairwise distances, summed in order of the dimensions: the same doubles as a fold over arrays.

    ``metric`` is a name, or a function that is called instead.
    """
    if callable(metric):
        return np.asarray(metric(a, b), np.float64)
    total = np.zeros((len(a), len(b)))
    if metric == "euclidean":
        for k in range(a.shape[1]):
            step = a[:, k, None] - b[None, :, k]
            total += step * step
        return np.sqrt(total)
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    for k in range(a.shape[1]):
        total += a[:, k, None] * b[None, :, k]
    aa, bb = (sum((x[:, k] * x[:, k] for k in range(x.shape[1])), np.zeros(len(x))) for x in (a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - total / np.sqrt(aa[:, None] * bb[None, :])
    none = (aa[:, None] == 0).astype(int) + (bb[None, :] == 0)
    return np.where(none == 2, 0.0, np.where(none == 1, 1.0, out))
