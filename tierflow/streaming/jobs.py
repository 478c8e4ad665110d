"""Streaming raw-to-bronze and near-real-time KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tierflow.operators.load import read_buckets, upsert_buckets
from tierflow.operators.rules import audited, validity_rules
from tierflow.operators.sinks import target_exists
from tierflow.plans.bronze import prepare
from tierflow.specs import EntitySpec

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    name_glob: str | None = None,
) -> DataFrame:
    """Files of a folder as they arrive, with their source file."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path).withColumn("_source_file", F.col("_metadata.file_path"))


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need an instant; a zone-less column is read in the session's time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_to_bronze(
    stream: DataFrame,
    spec: EntitySpec,
    date: str,
    timestamp: str,
    late_by: str,
    spread_copies: bool = True,
) -> DataFrame:
    """The bronze pass on a stream. Copies of a key within the watermark are dropped.

    ``spread_copies`` drops them per source file first, so that the copies of one
    key, however many, do not all reach one task. It keeps a second state of keys
    per file; turn it off where keys are known to repeat little.
    """
    df = prepare(event_time(stream, timestamp), spec)
    for rule in validity_rules(df, spec).values():
        df = df.where(rule)
    df = df.withWatermark(timestamp, late_by)
    if spread_copies:
        df = df.dropDuplicatesWithinWatermark([*spec.keys, "_source_file"])
    return audited(df.dropDuplicatesWithinWatermark(list(spec.keys)), date)


def tumbling(
    events: DataFrame, timestamp: str, width: str, keys: Sequence[str], *aggregates: Column
) -> DataFrame:
    return _windowed(events, F.window(timestamp, width), keys, aggregates)


def sliding(
    events: DataFrame, timestamp: str, width: str, step: str, keys: Sequence[str], *aggregates: Column
) -> DataFrame:
    return _windowed(events, F.window(timestamp, width, step), keys, aggregates)


def sliding_by_panes(
    events: DataFrame, timestamp: str, width_minutes: int, step_minutes: int, keys: Sequence[str], **aggregates: tuple[str, Column | str]
) -> DataFrame:
    """:func:`sliding` for aggregates that add up, given as ``name=(kind, column)`` with a kind of ``count``, ``sum``, ``min`` or ``max``.

    Events are folded once into panes as long as the greatest common divisor of width and step; windows are then merged from panes.
    So an event is one row, and only panes are copied to the ``width / pane`` windows that they belong to.
    """
    pane = gcd(width_minutes, step_minutes)
    fold = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    partial = [fold[kind](column).alias(name) for name, (kind, column) in aggregates.items()]
    panes = events.groupBy(F.window(timestamp, f"{pane} minutes").alias("pane"), *keys).agg(*partial)
    merged = [fold["sum" if kind == "count" else kind](name).alias(name) for name, (kind, _) in aggregates.items()]
    at = F.window_time("pane")
    return _windowed(panes, F.window(at, f"{width_minutes} minutes", f"{step_minutes} minutes"), keys, merged)


def sessions(
    events: DataFrame, timestamp: str, gap: str, keys: Sequence[str], *aggregates: Column
) -> DataFrame:
    """Windows that end after ``gap`` without an event. Set ``LOCAL_SESSIONS`` in the session to merge
    them inside each input partition first, so that a busy key is shuffled as sessions and
    not as events."""
    return _windowed(events, F.session_window(timestamp, gap), keys, aggregates)


def _windowed(events: DataFrame, window: Column, keys: Sequence[str], aggregates) -> DataFrame:
    grouped = events.groupBy(window.alias("window"), *keys).agg(*aggregates)
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *(c for c in grouped.columns if c != "window"),
    )


def with_watermark(events: DataFrame, timestamp: str, late_by: str) -> DataFrame:
    """Rows later than ``late_by`` behind the newest are dropped by stateful operators."""
    return event_time(events, timestamp).withWatermark(timestamp, late_by)


def start_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet all that is there now, then stop. Started again with the same
    ``checkpoint`` and ``path``, it goes on where it stopped; nothing is written twice."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_append(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """:func:`start_append`, awaited; returns the table."""
    start_append(df, path, checkpoint).awaitTermination()
    if not target_exists(df.sparkSession, path):  # nothing arrived
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_upsert(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, buckets: int | None = None
) -> DataFrame:
    """Each micro-batch merged into the table at ``path``; returns the table. Started again with the
    same ``checkpoint``, it goes on where it stopped; a batch that is repeated leads to the same rows."""
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, _: upsert_buckets(batch, path, keys, order, buckets)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_buckets(stream.sparkSession, path, stream.schema)
