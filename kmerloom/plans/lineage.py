"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting a query's shuffle files when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one, and any other is an error: executors of a cluster could not
    read what others wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table from the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written within go at the end, but for those to be kept: they go with the scratch around, if any."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Queries that run within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """df written to the path and read back; see scratch() for how long it stays."""
    spark = df.sparkSession
    if (own := _SCRATCH[:-1] if keep else _SCRATCH):
        own[-1].append(path)
    with without_shuffle_files(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, what: str = "step", keep: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    return written(df, new_path(df.sparkSession, what), keep)
