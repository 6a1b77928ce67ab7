"""Where operators keep intermediate tables and files, and small helpers.

Intermediate results go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver can read it, so a lost
executor never takes the only copy with it.
"""

from __future__ import annotations

import contextlib

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifolder.operators.session import Scratch


class Workspace(Scratch):
    """A private folder of the shared one, deleted when Python ends."""

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: lineage ends here."""
        return self.keep(df, name)


def unused_name(docs: DataFrame, wanted: str) -> str:
    """A column name that ``docs`` doesn't have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def column(name: str):
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells apart rows that are alike in all others, and its name.

    Rows read from files are known by their file and place in it, so they need
    not be written again; those of any other table are written with a number.
    Either is the same whenever the rows are read again.
    """
    name = unused_name(docs, "row")
    with contextlib.suppress(AnalysisException):
        placed = docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
        placed.schema  # noqa: B018  raises where the rows don't come from files
        return placed, name
    return ws.table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path for a URI of the shared folder."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(units: int, per_part: int, least: int = 1) -> int:
    """Partitions that hold about ``per_part`` units each, however many there are."""
    return max(least, -(-int(units) // per_part))


WORD = r"[^\x20\x09-\x0D]+"
