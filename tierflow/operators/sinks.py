"""Writes: partition overwrite, text reports, raw JSON and CSV, compaction, erasure."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierflow.workspace import staging_path


class EmptyInput(ValueError):
    """There is nothing to write."""


class TargetExists(ValueError):
    """The target is there and overwriting was not allowed."""


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput("refusing to write an empty table")
    return df


def target_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists. Errors other than absence are raised, not taken as absence."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _guarded(df: DataFrame, path: str, allow_overwrite: bool) -> str:
    if not allow_overwrite and target_exists(df.sparkSession, path):
        raise TargetExists(f"{path} exists; pass allow_overwrite=True to replace it")
    return "overwrite" if allow_overwrite else "errorifexists"


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by partition value for few files per directory; adaptive execution splits
    a hot value over several tasks and joins small ones."""
    return df.hint("rebalance", *(F.col(c) for c in columns))


def write_partitions(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    mode: str = "overwrite",
    compression: str = "snappy",
) -> None:
    """Parquet by partition. ``overwrite`` replaces only the partitions that ``df`` holds, which
    makes a re-run replace its own output."""
    (
        balanced(df, *partition_by)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(*partition_by)
        .parquet(path)
    )


# Text formats that keep microseconds.
_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_WALL_CLOCK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_EXACT_TIMES = {"timestampFormat": _INSTANT, "timestampNTZFormat": _WALL_CLOCK}


def write_raw_json(df: DataFrame, path: str, allow_overwrite: bool = False) -> None:
    """One JSON object per line."""
    mode = _guarded(df, path, allow_overwrite)
    require_rows(df).write.mode(mode).options(**_EXACT_TIMES).json(path)


def write_raw_csv(df: DataFrame, path: str, allow_overwrite: bool = False) -> None:
    """CSV with its columns in name order; nulls are empty."""
    mode = _guarded(df, path, allow_overwrite)
    ordered = require_rows(df).select(*sorted(df.columns))
    ordered.write.mode(mode).options(**_EXACT_TIMES, header=True, escape='"').csv(path)


def union_sorted_fields(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns in name order, missing ones null."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.select(*sorted(first.columns))


def make_way(spark: SparkSession, path: str, allow_overwrite: bool) -> None:
    """Refuse a target that is there, or remove it where overwriting is allowed."""
    if target_exists(spark, path):
        if not allow_overwrite:
            raise TargetExists(f"{path} exists; pass allow_overwrite=True to replace it")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def write_report(report: DataFrame, path: str) -> None:
    """Reports of one string column as text, one line each."""
    report.write.mode("overwrite").text(path)


def directory_bytes(spark: SparkSession, path: str) -> int:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(jvm_path).getLength()


def directory_files(spark: SparkSession, path: str) -> int:
    """The number of data files that Spark has written to a directory without partitions. Their names stay in the JVM."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "part-*")
    return len(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    cluster_by: Sequence[str],
    target_bytes: int = 512 * 1024 * 1024,
) -> int:
    """Rewrite of a Parquet directory into files of about ``target_bytes``, range-clustered so
    that filters on ``cluster_by`` skip files. Returns the number of ranges."""
    files = max(1, math.ceil(directory_bytes(spark, source) / target_bytes))
    df = spark.read.parquet(source)
    # The row hash lets a value that fills many files be split between them.
    ranged = df.repartitionByRange(files, *cluster_by, F.xxhash64(*df.columns))
    ranged.sortWithinPartitions(*cluster_by).write.mode("errorifexists").parquet(target)
    return files


def retained(df: DataFrame, date: str, today: Column, days: int) -> DataFrame:
    """Rows at most ``days`` days older than ``today``; prunes partitions if ``date`` is one."""
    return df.where(F.col(date) >= F.date_sub(today, days))


def expire_partitions(spark: SparkSession, path: str, partition: str, oldest: str) -> list[str]:
    """Directories of a partitioned table below ``oldest`` removed; returns their values. Values
    must sort like what they stand for, as ISO dates do."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = []
    for status in files.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name == partition and value < oldest:
            files.delete(status.getPath(), True)
            removed.append(value)
    return sorted(removed)


def erase(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows of the listed subjects. Rows without a key stay."""
    return df.join(subjects.select(key).distinct(), key, "left_anti")


def erase_table(spark: SparkSession, source: str, subjects: DataFrame, key: str) -> tuple[str, int]:
    """Erasure of a Parquet table into a new directory, and the number of rows removed.
    The caller swaps directories; the table being read is never overwritten."""
    df = spark.read.parquet(source)
    target = staging_path(spark, "erased")
    erase(df, subjects, key).write.parquet(target)
    return target, df.count() - spark.read.parquet(target).count()


def allowed_rows(df: DataFrame, grants: DataFrame, user: str, on: str) -> DataFrame:
    """Rows whose ``on`` value is granted to ``user``; ``grants`` has ``user`` and ``on``."""
    return df.join(grants.where(F.col("user") == user).select(on), on, "left_semi")
