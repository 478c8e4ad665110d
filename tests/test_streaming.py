from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tierflow.operators import load
from tierflow.specs import EntitySpec
from tierflow.streaming import jobs

SCHEMA = "id int, k string, t timestamp_ntz, value double"


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def arrivals(spark, tmp_path, *batches):
    """Each batch as one file; files are read one at a time, in the order written."""
    folder = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.read_stream(spark, folder, schema, files_per_trigger=1)


def appended(tmp_path, result):
    return jobs.run_append(result, str(tmp_path / "out"), str(tmp_path / "out-state"))


BATCHES = (
    [(1, "a", at(1), 1.0), (2, "a", at(1, 20), 2.0), (3, "b", at(1, 50), 4.0)],
    [(4, "a", at(5), 8.0)],
    # Rows count as late by the watermark that the batch before had.
    [(8, "b", at(5, 1), 128.0)],
    # Behind the watermark of 04:50: dropped. The other row is late but in time.
    [(5, "a", at(1, 30), 16.0), (6, "a", at(4, 55), 32.0), (7, "b", at(9), 64.0)],
)


def test_tumbling_drops_late_rows(spark, tmp_path, rows):
    stream = jobs.with_watermark(arrivals(spark, tmp_path, *BATCHES), "t", "10 minutes")
    result = jobs.tumbling(stream, "t", "1 hour", ["k"], F.sum("value").alias("total"))
    got = appended(tmp_path, result).select(F.hour("window_start"), "k", "total")
    assert rows(got) == [(1, "a", 3.0), (1, "b", 4.0), (4, "a", 32.0), (5, "a", 8.0), (5, "b", 128.0)]


def test_sliding(spark, tmp_path, rows):
    stream = jobs.with_watermark(arrivals(spark, tmp_path, *BATCHES[:2]), "t", "10 minutes")
    result = jobs.sliding(stream, "t", "1 hour", "30 minutes", [], F.count("*").alias("n"))
    got = appended(tmp_path, result).select(F.date_format("window_start", "HH:mm"), "n")
    assert rows(got) == [("00:30", 2), ("01:00", 3), ("01:30", 1)]


def test_sessions(spark, tmp_path, rows):
    stream = jobs.with_watermark(arrivals(spark, tmp_path, *BATCHES[:2]), "t", "10 minutes")
    result = jobs.sessions(stream, "t", "25 minutes", ["k"], F.count("*").alias("n"))
    got = appended(tmp_path, result).select("k", F.date_format("window_end", "HH:mm"), "n")
    assert rows(got) == [("a", "01:45", 2), ("b", "02:15", 1)]


@pytest.mark.parametrize("spread", [True, False])
def test_bronze_stream(spark, tmp_path, spread):
    stream = arrivals(
        spark, tmp_path, [(1, " a ", at(1), 1.0), (1, "again", at(1, 1), 1.0)], [(1, "later", at(1, 2), 1.0), (4, "e", at(2), 1.0), (4, "f", at(2), 1.0), (2, "b", at(2), -1.0), (None, "c", at(2), 1.0), (3, "d", at(2), 5.0)]
    )
    spec = EntitySpec("x", trims=("k",), positives=("value",))
    got = appended(tmp_path, jobs.stream_to_bronze(stream, spec, "20240101", "t", "1 day", spread)).collect()
    assert sorted((r["id"], r["_processing_date"]) for r in got) == [(1, "20240101"), (3, "20240101"), (4, "20240101")]
    assert all(r["_source_file"].endswith(".parquet") and r["k"] == r["k"].strip() for r in got)


def test_upsert_stream(spark, tmp_path, rows):
    stream = arrivals(spark, tmp_path, *BATCHES).drop("_source_file")
    got = jobs.run_upsert(stream, ["k"], ["-t"], str(tmp_path / "u"), str(tmp_path / "state"), buckets=4)
    # The row of 04:55 comes after that of 05:00 and does not displace it.
    assert rows(got.select("k", "id")) == [("a", 4), ("b", 7)]


def test_streams_go_on_where_they_stopped(spark, tmp_path, rows):
    """Stopped after two files, started again with all: the same as in one go, and as in a batch."""

    def run():
        stream = jobs.with_watermark(arrivals(spark, tmp_path), "t", "10 minutes")
        jobs.run_append(stream.drop("_source_file"), str(tmp_path / "copy"), str(tmp_path / "copy-state"))
        jobs.run_upsert(arrivals(spark, tmp_path).drop("_source_file"), ["k"], ["-t"], str(tmp_path / "u"), str(tmp_path / "u-state"))

    arrivals(spark, tmp_path, *BATCHES[:2])
    run()
    arrivals(spark, tmp_path, *BATCHES[2:])
    run()
    run()
    everything = sorted(r[0] for batch in BATCHES for r in batch)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "copy")).collect()) == everything
    schema = spark.createDataFrame([], SCHEMA).schema
    assert rows(load.read_buckets(spark, str(tmp_path / "u"), schema).select("k", "id")) == [("a", 4), ("b", 7)]


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
    assert appended(tmp_path, stream).count() == 0
    assert jobs.run_upsert(stream, ["k"], ["-t"], str(tmp_path / "none"), str(tmp_path / "none-state")).count() == 0


def test_watermark_needs_an_instant(spark, tmp_path):
    stream = arrivals(spark, tmp_path, BATCHES[0])
    with pytest.raises(Exception, match="EVENT_TIME_IS_NOT_ON_TIMESTAMP_TYPE"):
        stream.withWatermark("t", "1 minute").schema
