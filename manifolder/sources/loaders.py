"""Point sets from files and generators, as points(id, x, label).

Files are read by Spark (``binaryFile``, ``csv``, ``parquet``), so any store
that Spark reads will do; decoders work on bytes within tasks.
"""

from __future__ import annotations

import io
import pickle
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifolder.functions.random import normal, uniform
from manifolder.operators.metrics import dense_ids
from manifolder.operators.resample import scale_global, stride_sample, tile_dimensions

POINTS = "id long, x array<double>, label double"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def parquet_points(spark: SparkSession, path: str, id_col: str | None = None, vector_col: str = "x", label_col: str | None = None) -> DataFrame:
    """Vectors of a Parquet table; rows are numbered in order of the vectors where there is no id."""
    df = spark.read.parquet(path)
    label = F.col(label_col).cast("double") if label_col else F.lit(1.0)
    points = df.select(*([F.col(id_col).alias("key")] if id_col else []), F.col(vector_col).cast("array<double>").alias("x"), label.alias("label"))
    return dense_ids(points, "key" if id_col else "x", "id").select("id", "x", "label")


def decode_idx(data: bytes) -> np.ndarray:
    """An IDX file: two zero bytes, a type, the number of dimensions, their sizes, the values."""
    kinds = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
    zero, kind, dims = struct.unpack(">HBB", data[:4])
    if zero or kind not in kinds:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{dims}I", data[4 : 4 + 4 * dims])
    return np.frombuffer(data, kinds[kind], int(np.prod(shape)), 4 + 4 * dims).reshape(shape)


def idx_points(spark: SparkSession, images: str, labels: str | None = None) -> DataFrame:
    """Images (and labels) of IDX files: a row for each image, its pixels in one vector."""

    def rows(frames):
        for frame in frames:
            for data in frame["content"]:
                values = decode_idx(bytes(data))
                flat = values.reshape(len(values), -1).astype(np.float64)
                for at in range(0, len(flat), 4096):
                    yield pd.DataFrame({"id": np.arange(at, min(at + 4096, len(flat))), "x": list(flat[at : at + 4096])})

    read = lambda path: spark.read.format("binaryFile").load(path).select("content")
    points = read(images).mapInPandas(rows, "id long, x array<double>")
    if labels is None:
        return points.withColumn("label", F.lit(1.0))
    return points.join(read(labels).mapInPandas(rows, "id long, x array<double>").select("id", F.col("x")[0].alias("label")), "id")


class _Arrays(pickle.Unpickler):
    """Reads pickles of plain containers and NumPy arrays; everything else is refused."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"):
            return super().find_class(module.replace("numpy.core", "numpy._core"), name)
        if (module, name) == ("_codecs", "encode"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't read from a data file")


def pickled_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batches of images as dictionaries with ``data`` and ``labels``."""

    def rows(frames):
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                batch = _Arrays(io.BytesIO(bytes(data)), encoding="latin1").load()
                flat = np.asarray(batch["data"], np.float64)
                yield pd.DataFrame({"file": name, "nth": np.arange(len(flat)), "x": list(flat), "label": np.asarray(batch["labels"], np.float64)})

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, nth long, x array<double>, label double")
    return dense_ids(read.withColumn("key", F.struct("file", "nth")), "key", "id").select("id", "x", "label")


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder, red, green and blue of each pixel in turn; the label is the number among the first six characters of the file name."""
    read = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def pixels(batches):
        for batch in batches:
            rows = []
            for data, channels in zip(batch.column(1), batch.column(2).to_pylist()):
                flat = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, channels)
                order = [2, 1, 0, *range(3, channels)] if channels >= 3 else range(channels)  # Spark has blue first
                rows.append(flat[:, order].ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["key", "x"])

    found = read.select(F.col("origin").alias("key"), "data", "nChannels").mapInArrow(pixels, "key string, x array<double>")
    name = F.substring(F.element_at(F.split("key", "/"), -1), 1, 6)
    return dense_ids(found.withColumn("label", F.regexp_extract(name, r"(\d+)", 1).cast("double")), "key", "id").select("id", "x", "label")


def hdf5_points(spark: SparkSession, path: str, group: str = "train", data: str = "data", target: str = "target") -> DataFrame:
    """``group/data`` and ``group/target`` of HDF5 files; needs the h5py library on the executors."""
    try:
        import h5py  # noqa: F401
    except ImportError as error:
        raise NotImplementedError("HDF5 files need the h5py library") from error

    def rows(frames):
        import h5py

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with h5py.File(io.BytesIO(bytes(content)), "r") as f:
                    flat = np.asarray(f[group][data], np.float64).reshape(len(f[group][data]), -1)
                    yield pd.DataFrame({"file": name, "nth": np.arange(len(flat)), "x": list(flat), "label": np.asarray(f[group][target], np.float64)})

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, nth long, x array<double>, label double")
    return dense_ids(read.withColumn("key", F.struct("file", "nth")), "key", "id").select("id", "x", "label")


def word_vectors(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """CSV with a header, a word and its numbers, in the order of the files; all labels are 1.

    ``most`` keeps the first rows of that order.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    numbers = [F.col(f"`{c}`").cast("double") for c in df.columns[1:]]
    rows = dense_ids(df.select(F.monotonically_increasing_id().alias("key"), F.array(*numbers).alias("x")), "key", "id")
    return (rows if most is None else rows.where(F.col("id") < most)).select("id", "x", F.lit(1.0).alias("label"))


def single_cell(spark: SparkSession, expression: str, metadata: str, class_column: str) -> DataFrame:
    """Genes x cells CSV, turned, with the class of each cell from the metadata CSV (``cell`` in its first column)."""
    genes = spark.read.csv(expression, header=True, inferSchema=False)
    gene, *cells = genes.columns
    long = genes.select(F.col(f"`{gene}`").alias("gene"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cells]), F.array(*[F.col(f"`{c}`").cast("double") for c in cells]))).alias("cell", "v"))
    vectors = long.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "v"))), lambda e: e["v"]).alias("x"))
    about = spark.read.csv(metadata, header=True, inferSchema=False)
    names = about.select(F.col(f"`{about.columns[0]}`").alias("cell"), F.col(f"`{class_column}`").alias("class"))
    codes = names.select("class").distinct().withColumn("label", (F.row_number().over(Window.orderBy("class")) - 1).cast("double"))
    labelled = vectors.join(names.join(F.broadcast(codes), "class"), "cell")
    return dense_ids(labelled, "cell", "id").select("id", "x", "label")


def swiss_roll(spark: SparkSession, n: int, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """A rolled-up plane in three dimensions; all labels are 1."""
    base = spark.range(n).withColumn("t", (uniform(seed, F.col("id")) * 2 + 1) * (1.5 * np.pi)).withColumn("h", uniform(seed + 1, F.col("id")) * 21)
    xyz = [F.col("t") * F.cos("t"), F.col("h"), F.col("t") * F.sin("t")]
    noisy = [c + normal(seed + 2, F.col("id"), F.lit(k)) * noise for k, c in enumerate(xyz)]
    return base.select("id", F.array(*noisy).alias("x"), F.lit(1.0).alias("label"))


def fake_gaussian(spark: SparkSession, n: int = 100, dim: int = 10, seed: int = 12345) -> DataFrame:
    """Standard normal vectors with labels 0 to 9 at random."""
    x = [normal(seed, F.col("id"), F.lit(k)) for k in range(dim)]
    return spark.range(n).select("id", F.array(*x).alias("x"), F.floor(uniform(seed, F.col("id"), F.lit(dim)) * 10).cast("double").alias("label"))


def fake_clusters(spark: SparkSession, n: int = 100, dim: int = 10, classes: int = 2, seed: int = 12345) -> DataFrame:
    """Equal runs of rows around class number times the all-ones vector, with variance 0.1."""
    label = F.least(F.floor(F.col("id") * classes / n), F.lit(classes - 1)).cast("double")
    x = [F.col("label") + normal(seed, F.col("id"), F.lit(k)) * float(np.sqrt(0.1)) for k in range(dim)]
    return spark.range(n).withColumn("label", label).select("id", F.array(*x).alias("x"), "label")


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "parquet": parquet_points,
    "idx": idx_points,
    "pickled_batches": pickled_batches,
    "image_folder": image_folder,
    "hdf5": hdf5_points,
    "word_vectors": word_vectors,
    "single_cell": single_cell,
    "embeddings": embeddings,
    "swiss_roll": swiss_roll,
    "fake_gaussian": fake_gaussian,
    "fake_clusters": fake_clusters,
}


def get_dataset(spark: SparkSession, name: str, *args, num_points: int | None = None, normalize: bool = True, desired_dim: int = -1, **options) -> DataFrame:
    """A source by name, resized in dimensions and points and divided by its largest value."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}; there are {', '.join(sorted(SOURCES))}")
    points = SOURCES[name](spark, *args, **options)
    if desired_dim > 0:
        points = tile_dimensions(points, desired_dim)
    if num_points:
        points = stride_sample(points, num_points)
    return scale_global(points) if normalize else points
