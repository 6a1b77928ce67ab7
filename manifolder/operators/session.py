"""Intermediate tables of iterative operators, in the folder that executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``; a temporary folder where that is unset and everything runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='manifolder-')}")
        return _own[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


class Scratch:
    """Tables written and read back, which ends their lineage; deleted at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.uri = spark, f"{shared_folder(spark)}/manifolder-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder."""
        with contextlib.suppress(Exception):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
