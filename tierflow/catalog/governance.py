"""Masking, redaction, row filters and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.functions import privacy
from tierflow.operators import erasure, sinks
from tierflow.workspace import staging_path


@query(
    """
    SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'),
             '[0-9]', 'n', 'g') AS name_masked,
           sha256('salt' || c_name) AS name_hash
    FROM customer"""
)
def mask_pii(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        privacy.mask_text(name).alias("name_masked"),
        privacy.pseudonym(name, "salt").alias("name_hash"),
    )


@query(
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '<email>', 'g'),
             '[0-9]{6,}', '<number>', 'g') AS text
    FROM documents"""
)
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.redact(F.col("text")).alias("text"))


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def row_level_filter(spark, sf_dir):
    """A user who may see the nations of one region."""
    grants = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("analyst_"), "n_regionkey").alias("user"), F.col("n_nationkey").alias("c_nationkey")
    )
    return sinks.allowed_rows(table(spark, sf_dir, "customer"), grants, "analyst_1", "c_nationkey")


@query(
    """
    SELECT event_id, user_id, event_type, value,
           (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal <= 0)) AS n_removed
    FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal <= 0)"""
)
def erase_subjects(spark, sf_dir):
    """A stored event table rewritten without the events of insolvent customers."""
    path = staging_path(spark, "events")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.parquet(path)
    subjects = table(spark, sf_dir, "customer").where("c_acctbal <= 0").select(F.col("c_custkey").alias("user_id"))
    target, removed = sinks.erase_table(spark, path, subjects, "user_id")
    return spark.read.parquet(target).withColumn("n_removed", F.lit(removed).cast("long"))


@query("SELECT event_id, user_id, event_type, ts FROM events WHERE user_id IS NULL OR user_id % 50 <> 7")
def erase_by_file(spark, sf_dir):
    """Users erased from files clustered by user; files without them stay as they are."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    path = staging_path(spark, "clustered")
    events.repartitionByRange(16, "user_id").write.parquet(path)
    erasure.erase_by_file(spark, path, events.where("user_id % 50 = 7").select("user_id"), "user_id")
    return spark.read.schema(events.schema).parquet(path)
