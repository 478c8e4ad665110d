"""Streaming bronze and windowed KPIs, with batch twins of the windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.functions.money import exact_sum, money
from tierflow.operators import marts
from tierflow.specs import EntitySpec
from tierflow.streaming import capture, jobs
from tierflow.workspace import staging_path

NTZ = "timestamp_ntz"


def _window_columns(df):
    """Window bounds as wall-clock times of the session's zone, like the input."""
    return df.withColumns({c: F.col(c).cast(NTZ) for c in ("window_start", "window_end")})


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return jobs.read_stream(spark, sf_dir, schema, name_glob="events.parquet")


def _appended(spark, result, name):
    return jobs.run_append(result, staging_path(spark, name), staging_path(spark, f"{name}-state"))


def _aggregates():
    return F.count("*").alias("n"), exact_sum(money(F.col("value"))).alias("total")


@query(
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total
    FROM events GROUP BY ALL"""
)
def kpi_tumbling(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return _window_columns(jobs.tumbling(events, "ts", "1 hour", ["event_type"], *_aggregates()))


@query(
    """
    WITH w AS (
      SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS s, value FROM events
      UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, value FROM events)
    SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total
    FROM w GROUP BY 1, 2"""
)
def kpi_sliding(spark, sf_dir):
    """Windows merged from panes of half an hour."""
    events = table(spark, sf_dir, "events").select("ts", money(F.col("value")).alias("value"))
    windows = jobs.sliding_by_panes(events, "ts", 60, 30, [], n=("count", "*"), total=("sum", "value"))
    return _window_columns(windows.withColumn("total", F.col("total").cast("double")))


@query(
    """
    WITH m AS (
      SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS opens FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events
    FROM s GROUP BY user_id, k"""
)
def kpi_session(spark, sf_dir):
    return marts.session_kpis(table(spark, sf_dir, "events"), "user_id", "ts", gap_minutes=360)


@query(
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total
    FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
      <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
    GROUP BY ALL"""
)
def stream_tumbling(spark, sf_dir):
    """The windows that the watermark has closed once the stream has read everything."""
    stream = jobs.with_watermark(_event_stream(spark, sf_dir).select("ts", "event_type", "value"), "ts", "10 minutes")
    result = jobs.tumbling(stream, "ts", "1 hour", ["event_type"], *_aggregates())
    return _window_columns(_appended(spark, result, "tumbling"))


@query(
    """
    WITH m AS (
      SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS opens FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n
    FROM s GROUP BY user_id, k
    HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def stream_session(spark, sf_dir):
    stream = jobs.with_watermark(_event_stream(spark, sf_dir).select("ts", "user_id"), "ts", "10 minutes")
    result = jobs.sessions(stream, "ts", "6 hours", ["user_id"], F.count("*").alias("n"))
    return _window_columns(_appended(spark, result, "sessions"))


@query("SELECT event_id AS id, ts AS event_time, event_type, value FROM events WHERE value > 0")
def stream_bronze(spark, sf_dir):
    """Events that arrive twice, in two files, through the bronze pass of a stream."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ID"), F.col("ts").alias("Event-Time"), F.col("event_type").alias("Event Type"), "value"
    )
    folder = staging_path(spark, "arrivals")
    for _ in range(2):
        events.write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, events.schema)
    spec = EntitySpec("events", positives=("value",))
    renamed = stream.withColumnRenamed("Event-Time", "event_time")
    bronze = jobs.stream_to_bronze(renamed, spec, "20240131", "event_time", "31 days")
    written = _appended(spark, bronze, "bronze")
    return written.select("id", F.col("event_time").cast(NTZ).alias("event_time"), "event_type", "value")


@query(
    """
    SELECT user_id, event_id, event_type, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def stream_upsert(spark, sf_dir):
    """The latest event per user, kept in a bucketed table by micro-batches that come out of order:
    the last third of the month first, then the first, then the rest."""
    events, folder = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), staging_path(spark, "unordered")
    day, path, state = F.dayofmonth("ts"), staging_path(spark, "latest-event"), staging_path(spark, "latest-event-state")
    for part in (day > 20, day <= 10, (day > 10) & (day <= 20)):
        events.where(part).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, events.schema).drop("_source_file")
        latest = jobs.run_upsert(stream, ["user_id"], ["-ts", "-event_id"], path, state, buckets=8)
    return latest


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'P'"""
)
def stream_cdc(spark, sf_dir):
    """A change log on a stream, which starts again for every part of it: finished orders are deleted before the update that
    the deletion follows arrives; pending ones are updated before they are inserted; the deletions come twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    done, pending = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'")
    raised = F.col("o_totalprice") + 1

    def change(rows, op, seq):
        at = F.lit("2024-01-01 00:00:00").cast(NTZ) + F.make_dt_interval(hours=F.lit(seq))
        return rows.withColumns({"op": F.lit(op), "seq": F.lit(seq), "changed_at": at})

    deleted = change(done, "D", 2)
    parts = [
        change(orders.where("o_orderstatus <> 'P'"), "I", 0).unionByName(change(pending.withColumn("o_totalprice", raised), "U", 3)),
        deleted,
        change(done.withColumn("o_totalprice", raised), "U", 1).unionByName(change(pending, "I", 0)).unionByName(deleted),
    ]
    folder, path, state = (staging_path(spark, x) for x in ("changes", "captured", "captured-state"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, part.schema).drop("_source_file")
        living = capture.run_capture(stream, ["o_orderkey"], ["seq"], "changed_at", "6 hours", path, state, buckets=8)
    return living.select(*orders.columns)
