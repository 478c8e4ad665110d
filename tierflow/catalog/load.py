"""Incremental loads, merges, partitioned writes, compaction and re-runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.operators import layout, load, rules, sinks
from tierflow.workspace import staging_path


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')"""
)
def incremental_load(spark, sf_dir):
    """Orders beyond the last one of an earlier load."""
    orders = _orders(spark, sf_dir)
    loaded = orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return load.incremental(orders, loaded, "o_orderdate")


@query(
    f"""
    SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, o_custkey, 'U', o_totalprice + 2, o_orderdate FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_custkey, 'P', o_totalprice + 2, o_orderdate FROM orders WHERE o_orderstatus = 'P'"""
)
def merge_upsert(spark, sf_dir):
    """Finished orders change twice and pending ones are new."""
    orders = _orders(spark, sf_dir)
    target = orders.where("o_orderstatus <> 'P'")
    touched = orders.where("o_orderstatus <> 'O'").withColumn(
        "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "U").otherwise(F.col("o_orderstatus"))
    )
    changes = touched.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(1)}).unionByName(
        touched.withColumns({"o_totalprice": F.col("o_totalprice") + 2, "version": F.lit(2)})
    )
    return load.merge_upsert(target, changes, ["o_orderkey"], ["-version"])


@query(
    f"""
    SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate FROM orders WHERE o_orderstatus = 'P'"""
)
def cdc_apply(spark, sf_dir):
    """Finished orders are updated and then deleted; pending ones are inserted."""
    orders = _orders(spark, sf_dir)
    done, pending = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'")
    raised = F.col("o_totalprice") + 1
    log = (
        done.withColumns({"o_totalprice": raised, "op": F.lit("U"), "seq": F.lit(1)})
        .unionByName(done.withColumns({"op": F.lit("D"), "seq": F.lit(2)}))
        .unionByName(pending.withColumns({"o_totalprice": raised, "op": F.lit("I"), "seq": F.lit(1)}))
    )
    return load.apply_cdc(orders.where("o_orderstatus <> 'P'"), log, ["o_orderkey"], ["-seq"])


@query(
    f"""
    SELECT {_COLUMNS} FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_orderkey % 11 <> 3
    UNION ALL SELECT {_COLUMNS} FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderstatus <> 'F' AND o_orderkey % 11 <> 3"""
)
def incremental_deletes(spark, sf_dir):
    """Later orders are loaded, of which finished ones are marked as deleted; a log removes more, old ones and new."""
    orders = _orders(spark, sf_dir)
    border = F.lit("1999-01-01").cast("timestamp_ntz")
    loaded = orders.where(F.col("o_orderdate") < border)
    late = F.lit("2030-01-01").cast("timestamp_ntz")
    log = orders.where("o_orderkey % 11 = 3").select("o_orderkey", late.alias("o_orderdate"))
    deleted = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= border)
    return load.incremental_merge(orders, loaded, ["o_orderkey"], "o_orderdate", deleted, log).select(*orders.columns)


@query(f"SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'P'")
def detect_deletes(spark, sf_dir):
    """The current full load lacks the pending orders."""
    orders = _orders(spark, sf_dir)
    return load.detect_deletes(orders, orders.where("o_orderstatus <> 'P'"), ["o_orderkey"])


@query(
    f"""
    SELECT {_COLUMNS} FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate FROM orders WHERE o_orderstatus = 'F'"""
)
def upsert_table(spark, sf_dir):
    """Batches merged into a bucketed table on disk: later prices come before earlier ones, and twice."""
    orders, path = _orders(spark, sf_dir), staging_path(spark, "upserted")
    raised = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    for batch in (raised, orders, raised):
        load.upsert_buckets(batch, path, ["o_orderkey"], ["-o_totalprice"], buckets=8)
    return load.read_buckets(spark, path, orders.schema)


_EVENT_COLUMNS = ("event_id", "user_id", "event_type", "value", "ts")


def _dated_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(*_EVENT_COLUMNS).withColumns(
        {
            "year": F.year("ts"),
            "month": F.month("ts"),
            "day": F.day("ts"),
            "source_system": F.when(F.col("event_type") == "purchase", "shop").otherwise("web"),
        }
    )


@query(
    """
    SELECT source_system, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, count(*) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS total
    FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'shop' ELSE 'web' END AS source_system FROM events
          UNION ALL SELECT *, 'shop' FROM events WHERE event_type = 'purchase')
    GROUP BY ALL"""
)
def partitioned_write_roundtrip(spark, sf_dir):
    """Events by source and day in ZSTD files, then one source appended once more."""
    events, path = _dated_events(spark, sf_dir), staging_path(spark, "partitioned")
    keys = ["source_system", "year", "month", "day"]
    sinks.write_partitions(events, path, keys, compression="zstd")
    sinks.write_partitions(events.where("source_system = 'shop'"), path, keys, mode="append")
    return (
        spark.read.schema(events.schema)
        .parquet(path)
        .groupBy("source_system", "month", "day")
        .agg(F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"))
    )


@query("SELECT event_id, user_id, event_type, value, ts FROM events")
def compact_roundtrip(spark, sf_dir):
    """Many small files rewritten into few, clustered by user and time."""
    events = table(spark, sf_dir, "events").select(*_EVENT_COLUMNS)
    small, target = staging_path(spark, "small-files"), staging_path(spark, "compacted")
    events.repartition(32).write.parquet(small)
    sinks.compact(spark, small, target, ["user_id", "ts"], target_bytes=128 * 1024)
    return spark.read.parquet(target)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem")
def zorder_roundtrip(spark, sf_dir):
    """Lines rewritten along a space-filling curve over part and date."""
    lines, small = table(spark, sf_dir, "lineitem"), staging_path(spark, "small-files")
    lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").write.parquet(small)
    target = staging_path(spark, "z-ordered")
    layout.compact_z_ordered(spark, small, target, ["l_partkey", "l_shipdate"], target_bytes=32 * 1024)
    return spark.read.parquet(target)


@query(
    """
    SELECT 'l_partkey' AS filtered, count(*) AS n_rows, true AS few_files FROM lineitem, (SELECT max(p_partkey) AS m FROM part)
    WHERE l_partkey BETWEEN m // 2 AND m // 2 + m // 50
    UNION ALL SELECT 'l_shipdate', count(*), true FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-15'"""
)
def zorder_pruning(spark, sf_dir):
    """Filters on either of two columns open at most two fifths of 64 files along the curve."""
    lines, path = table(spark, sf_dir, "lineitem"), staging_path(spark, "z-ordered")
    layout.z_ordered(lines, ["l_partkey", "l_shipdate"], 64).write.parquet(path)
    stored = spark.read.parquet(path)
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    ranges = [
        ("l_partkey", top // 2, top // 2 + top // 50),
        ("l_shipdate", *(F.lit(x).cast("timestamp_ntz") for x in ("1997-03-01", "1997-04-15"))),
    ]
    rows = []
    for column, low, high in ranges:
        files = layout.opened_share(stored, column, low, high).first()
        few = F.lit(files["opened"] <= 0.4 * files["files"]).alias("few_files")
        rows.append(stored.where(F.col(column).between(low, high)).agg(F.lit(column).alias("filtered"), F.count("*").alias("n_rows"), few))
    return rows[0].unionByName(rows[1])


@query("SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS load_date FROM events")
def idempotent_rerun(spark, sf_dir):
    """A load of days that runs twice, the second time with every event repeated."""
    events, path = table(spark, sf_dir, "events").select(*_EVENT_COLUMNS), staging_path(spark, "rerun")
    for extracted in (events, events.unionByName(events)):
        loaded = rules.keep_first(extracted, ["event_id"]).withColumn("load_date", F.to_date("ts"))
        sinks.write_partitions(loaded, path, ["load_date"])
    return spark.read.schema(loaded.schema).parquet(path)


@query(
    """
    SELECT event_id, ts FROM events
    WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - 7"""
)
def retention_filter(spark, sf_dir):
    """Events of at most seven days before the latest one."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    today = events.agg(F.to_date(F.max("ts"))).scalar()
    kept = sinks.retained(events.withColumn("day", F.to_date("ts")), "day", today, 7)
    return kept.drop("day")
