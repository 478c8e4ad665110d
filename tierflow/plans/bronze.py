"""Raw to bronze."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierflow.functions.names import bronze_dir, bucket_path, normalize_columns, raw_glob
from tierflow.operators.quality import error_report, profile, quality_report, report_json
from tierflow.operators.rules import (
    Extraction,
    audited,
    clean_values,
    explode_records,
    keep_first,
    present,
    validity_rules,
)
from tierflow.operators.sinks import write_report
from tierflow.sources.files import CORRUPT, scan, split_corrupt
from tierflow.specs import EntitySpec
from tierflow.workspace import durable


def prepare(raw: DataFrame, spec: EntitySpec) -> DataFrame:
    """Records unpacked, names normalised, values cast and trimmed; no row rule applied yet."""
    df = explode_records(raw, spec.explode_path) if spec.explode_path else raw
    df = clean_values(normalize_columns(df), spec)
    absent = [c for c in spec.required if c not in df.columns]
    if absent:
        raise ValueError(f"{spec.name}: required columns are missing: {absent}")
    return df


def to_bronze(
    raw: DataFrame,
    spec: EntitySpec,
    date: str,
    dedup_first: bool = False,
    run_timestamp: Column | None = None,
) -> DataFrame:
    """The bronze rows of an entity.

    Invalid rows are filtered before copies of a key are dropped, so that a valid
    copy is never lost to an invalid one, and filters reach the scan.
    ``dedup_first`` drops copies first.
    """
    df = prepare(raw, spec)
    rules = validity_rules(df, spec)
    keys = present(df, spec.keys)
    if dedup_first and keys:
        df = keep_first(df, keys, spec.order)
    for rule in rules.values():
        df = df.where(rule)
    if keys and not dedup_first:
        df = keep_first(df, keys, spec.order)
    return audited(df, date, run_timestamp)


@dataclass
class BronzeRun:
    """Outcome of a bronze job. ``rows`` comes from the footers of the files written; the raw
    rows are only counted, in a scan of their own, when asked for."""

    path: str
    rows: int
    raw: DataFrame
    profile: DataFrame | None = None
    quarantined: int = 0

    @cached_property
    def raw_rows(self) -> int:
        return self.raw.count()

    @property
    def dropped(self) -> int:
        return self.raw_rows - self.rows


def run_bronze(
    spark: SparkSession,
    spec: EntitySpec,
    raw_path: str,
    bronze_path: str,
    date: str,
    dedup_first: bool = False,
    quarantine_path: str | None = None,
    extraction: Extraction | None = None,
) -> BronzeRun:
    """Scan, transform and overwrite one entity and day. An empty input writes nothing.

    The plan with its shuffle runs once, for the write; the row count and the profile
    are read from the written files. With a ``quarantine_path`` and a schema, records that do not
    parse go there with their text and source file, and not to bronze as rows of nulls. An ``extraction`` is written on
    every row, by which the run can be traced or withdrawn.
    """
    schema = spec.schema
    apart = quarantine_path is not None and schema is not None and spec.fmt in ("json", "csv", "xml")
    if apart and CORRUPT not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = scan(spark, raw_path, spec.fmt, schema, spec.multi_line, spec.row_tag)
    if raw.isEmpty():
        return BronzeRun(bronze_path, 0, raw)
    set_aside = 0
    if apart:
        raw, bad = split_corrupt(raw)
        bad.withColumn("_processing_date", F.lit(date)).write.mode("overwrite").parquet(quarantine_path)
        set_aside = spark.read.parquet(quarantine_path).count()
    stamp = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    bronze = to_bronze(raw, spec, date, dedup_first, stamp)
    if extraction is not None:
        bronze = extraction.on(bronze)
    bronze.write.mode("overwrite").parquet(bronze_path)
    written = spark.read.parquet(bronze_path)
    unpacked = explode_records(raw, spec.explode_path) if spec.explode_path else raw
    stats = profile(written, spec.profile) if spec.profile else None
    return BronzeRun(bronze_path, written.count(), unpacked, stats, set_aside)


def run_bronze_from_lake(
    spark: SparkSession,
    spec: EntitySpec,
    raw_bucket: str,
    bronze_bucket: str,
    prefix: str,
    date: str,
    dedup_first: bool = False,
    quarantine: bool = False,
    extraction: Extraction | None = None,
) -> BronzeRun:
    """:func:`run_bronze` on the lake's own paths; a quarantine lies below ``_quarantine`` in the bronze bucket."""
    source = bucket_path(raw_bucket, raw_glob(prefix, spec.source, spec.name, date, spec.fmt))
    target = bucket_path(bronze_bucket, bronze_dir(prefix, spec.source, spec.name, date))
    aside = bucket_path(bronze_bucket, f"_quarantine/{bronze_dir(prefix, spec.source, spec.name, date)}") if quarantine else None
    return run_bronze(spark, spec, source, target, date, dedup_first, aside, extraction)


def validate_bronze(
    spark: SparkSession,
    bronze_bucket: str,
    entity: str,
    prefix: str,
    date: str,
    key: str = "id",
    source: str = "api",
) -> DataFrame:
    """Quality report of a written bronze table, also stored as text beside it. A table that cannot
    be read gives a report with status ERROR."""
    path = bucket_path(bronze_bucket, bronze_dir(prefix, source, entity, date))
    try:
        report = durable(quality_report(spark.read.parquet(path), entity, date, key))
    except Exception as error:  # whatever keeps the table from being read belongs in the report
        report = durable(error_report(spark, entity, date, error))
    target = f"reports/{source}_{entity}_validation_{date}.txt"
    write_report(report_json(report), bucket_path(bronze_bucket, target))
    return report
