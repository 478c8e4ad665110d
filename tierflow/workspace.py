"""Shared folder for checkpoints, staged tables and streaming state."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_OPEN_RUNS: list[list[str]] = []


def use_shared_root(spark: SparkSession, path: str) -> None:
    """Name the shared folder of an application that runs without ``spark.checkpoint.dir``,
    as tests do. The setting goes before it."""
    _ROOTS[spark.sparkContext.applicationId] = path.rstrip("/")


def has_shared_root(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.applicationId in _ROOTS


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else what
    :func:`use_shared_root` has named. Without either there is none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _ROOTS.get(spark.sparkContext.applicationId)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never handed out twice."""
    path = f"{shared_root(spark)}/tierflow/{name}-{uuid.uuid4().hex}"
    for run in _OPEN_RUNS:
        run.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Staged tables of a block are deleted when it ends.

    Write what is to stay, to a path of your own, inside the block: tables that were not
    written may still need what is deleted.
    """
    _OPEN_RUNS.append(paths := [])
    try:
        yield
    finally:
        _OPEN_RUNS.remove(paths)
        for path in paths:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def runs_on_executors(module_name: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need no copy of
    this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs inside the block goes to Python workers in batches of about ``size`` bytes at most, or of one longer row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, with its lineage cut.

    Later readers see the same rows, also after executors are lost, and read only
    the columns they need.
    """
    path = staging_path(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
