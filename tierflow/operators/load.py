"""Incremental loads, merges and change capture."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierflow.operators.joins import null_safe_join
from tierflow.operators.rules import keep_first
from tierflow.operators.sinks import directory_bytes, target_exists
from tierflow.workspace import durable

BUCKET = "_bucket"
BUCKETS = 64
#: Changes are folded into the base when they have grown to this share of it, and to so many bytes.
FOLD_SHARE, FOLD_LEAST = 0.25, 32 << 20


def high_water_mark(target: DataFrame, control: str) -> Column | None:
    """Latest control value already loaded, as a literal; ``None`` for an empty target. An instant
    is carried as microseconds, since as text it would be told twice where clocks are set back."""
    kind = target.schema[control].dataType
    instant = isinstance(kind, T.TimestampType)
    latest = F.max(control)
    mark = target.agg((F.unix_micros(latest) if instant else latest.cast("string")).alias("mark")).first()["mark"]
    if mark is None:
        return None
    return F.timestamp_micros(F.lit(mark)) if instant else F.lit(mark).cast(kind)


def incremental(source: DataFrame, target: DataFrame, control: str) -> DataFrame:
    """Source rows beyond the target's high-water mark; all rows for an empty target. The mark
    is a constant of the plan, so that the filter reaches the scan."""
    mark = high_water_mark(target, control)
    return source if mark is None else source.where(F.col(control) > mark)


def merge_upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``target`` with the latest change per key updated or inserted. ``changes`` has the
    target's columns, and those ``order`` needs."""
    latest = keep_first(changes, keys, order)
    return _apply(target, latest.withColumn("_deleted", F.lit(False)), keys)


def apply_cdc(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op"
) -> DataFrame:
    """``target`` after a change log with operations I, U and D; the latest per key wins."""
    latest = keep_first(changes, keys, order)
    return _apply(target, latest.withColumn("_deleted", F.col(op) == "D"), keys)


def _apply(target: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a change, and the changes that are not deletions. Null keys match each other."""
    kept = null_safe_join(target, latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.where(~F.col("_deleted")).select(*target.columns))


def detect_deletes(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the previous full load whose key the current one lacks."""
    return previous.join(current.select(*keys), list(keys), "left_anti")


# A table kept by upserts has three folders: ``base`` and ``changes``, both partitioned by key hash, and
# ``layout`` with what they were made with.


def _layout(spark: SparkSession, path: str) -> dict | None:
    if not target_exists(spark, f"{path}/layout"):
        return None
    return spark.read.parquet(f"{path}/layout").first().asDict()


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of base and changes, with their bucket."""
    fields = T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())])
    parts = [f"{path}/{p}" for p in ("base", "changes") if target_exists(spark, f"{path}/{p}")]
    frames = [spark.read.schema(fields).parquet(p) for p in parts]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], fields)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table kept by :func:`upsert_buckets`: the first row of each key in the table's order. It has
    no rows before its first batch."""
    layout = _layout(spark, path)
    if layout is None:
        return spark.createDataFrame([], schema)
    rows = _stored(spark, path, schema).drop(BUCKET)
    return keep_first(rows, layout["keys"], layout["order"])


def upsert_buckets(
    batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int | None = None
) -> None:
    """``batch`` merged into the table at ``path``.

    A batch costs its own size: it is appended to the changes. Readers take the first row
    of each key in ``order`` over base and changes, so an older row never displaces a newer one, in
    whatever order batches come and however often. When the changes have grown to a share of the
    base, they are folded into it. Keys, order and the number of buckets are stored with the first
    batch; others are refused.
    """
    spark = batch.sparkSession
    layout = _layout(spark, path)
    wanted = {"keys": list(keys), "order": list(order)}
    if layout is None:
        layout = {**wanted, "buckets": buckets or BUCKETS}
        made = spark.createDataFrame([tuple(layout.values())], "keys array<string>, order array<string>, buckets int")
        made.coalesce(1).write.parquet(f"{path}/layout")
    if {**wanted, "buckets": buckets or layout["buckets"]} != layout:
        raise ValueError(f"{path} was made with {layout}")
    latest = keep_first(batch, keys, order)
    _write_buckets(latest, f"{path}/changes", keys, layout["buckets"], "append")
    base = directory_bytes(spark, f"{path}/base") if target_exists(spark, f"{path}/base") else 0
    if directory_bytes(spark, f"{path}/changes") > max(FOLD_LEAST, FOLD_SHARE * base):
        fold_buckets(spark, path, batch.schema)


def _write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int, mode: str) -> None:
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias(BUCKET)
    (
        df.withColumn(BUCKET, bucket)
        .hint("rebalance", F.col(BUCKET))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(path)
    )


def fold_buckets(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """The changes folded into the base, whose other buckets stay as they are.

    The merged rows are made durable before the overwrite, since a path must not be read while it
    is replaced. Only the files of changes that were read are removed: what another writer appends
    meanwhile stays for the next time. A run that breaks off leaves changes that the base already has, which make no
    difference to readers. One fold may run at a time.
    """
    layout = _layout(spark, path)
    fields = T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())])
    files = [unquote(f) for f in spark.read.schema(fields).parquet(f"{path}/changes").inputFiles()]
    if not files:
        return
    changes = spark.read.schema(fields).option("basePath", f"{path}/changes").parquet(*files)
    stored = changes
    if target_exists(spark, f"{path}/base"):
        stored = spark.read.schema(fields).parquet(f"{path}/base").unionByName(changes)
    touched = changes.select(BUCKET).distinct()
    rows = stored.join(F.broadcast(touched), BUCKET, "left_semi")  # at most one row per bucket
    merged = durable(keep_first(rows.drop(BUCKET), layout["keys"], layout["order"]))
    _write_buckets(merged, f"{path}/base", layout["keys"], layout["buckets"], "overwrite")
    for file in files:
        read = spark._jvm.org.apache.hadoop.fs.Path(file)
        read.getFileSystem(spark._jsc.hadoopConfiguration()).delete(read, False)


def incremental_changes(
    source: DataFrame, target: DataFrame, control: str, deleted: Column, log: DataFrame | None = None
) -> DataFrame:
    """Changes beyond the target's high-water mark as a change log with ``op``: a row whose ``deleted`` holds is a D, any other an U.
    A ``log`` of deletions has the target's keys and the control column; what it lacks is null."""
    marked = incremental(source, target, control).withColumn("op", F.when(F.coalesce(deleted, F.lit(False)), "D").otherwise("U"))
    if log is None:
        return marked
    removed = incremental(log, target, control).withColumn("op", F.lit("D"))
    return marked.unionByName(removed, allowMissingColumns=True)


def incremental_merge(
    source: DataFrame, target: DataFrame, keys: Sequence[str], control: str, deleted: Column, log: DataFrame | None = None
) -> DataFrame:
    """``target`` after an incremental load that says what was deleted, by a column of the source or by a log of deletions.
    Of changes of one key and time a deletion wins."""
    changes = incremental_changes(source, target, control, deleted, log).withColumn("_gone", (F.col("op") == "D").cast("int"))
    return apply_cdc(target, changes, keys, [f"-{control}", "-_gone"])
