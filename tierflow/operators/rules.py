"""Projections, filters and deduplication of the bronze pass."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow.functions.casts import lenient_cast
from tierflow.specs import EntitySpec

AUDIT_COLUMNS = ("_ingestion_timestamp", "_source_file", "_processing_date")


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def explode_records(df: DataFrame, path: str) -> DataFrame:
    """One row per element of the array of structs at ``path``, its fields as columns.

    Rows with a null or empty array yield nothing. A frame without ``path``
    passes through. The source-file column is kept.
    """
    if path not in df.columns:
        return df
    kept = present(df, AUDIT_COLUMNS)
    return df.select(*kept, F.explode(path).alias("_record")).select("_record.*", *kept)


def clean_values(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Casts and trims of a spec, for the columns that exist, in one projection."""
    types = {f.name: f.dataType for f in df.schema.fields}
    changed: dict[str, Column] = {
        c: lenient_cast(F.col(c), types[c], t) for c, t in spec.casts.items() if c in types
    }
    for c in present(df, spec.trims):
        changed[c] = F.trim(changed.get(c, F.col(c)).cast("string"))
    return df.withColumns(changed) if changed else df


def not_null(*columns: str) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def within(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Inclusive bounds on every column; null is outside."""
    condition = F.lit(True)
    for c, (low, high) in bounds.items():
        condition = condition & F.col(c).isNotNull() & F.col(c).between(low, high)
    return condition


def positive(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) > 0)


def validity_rules(df: DataFrame, spec: EntitySpec) -> dict[str, Column]:
    """The spec's row filters by name, in order; only those whose columns exist."""
    rules: dict[str, Column] = {}
    keys = present(df, spec.keys)
    if keys:
        rules["key_not_null"] = not_null(*keys)
    for number, box in enumerate(spec.boxes, start=1):
        if all(c in df.columns for c in box):
            rules[f"box_{number}"] = within(box)
    for c in present(df, spec.positives):
        rules[f"{c}_positive"] = positive(c)
    return rules


def _sort_columns(df: DataFrame, order: Sequence[str]) -> list[Column]:
    listed = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    # Any rows left in a tie are told apart by their content, so the survivor does not depend
    # on the partitioning.
    content = [
        F.to_json(F.struct(n)) if "map<" in t or "variant" in t else F.col(n)
        for n, t in df.dtypes
        if n not in AUDIT_COLUMNS
    ]
    # A hash skips nulls, so their places are hashed too.
    return [*listed, F.xxhash64(*(part for c in content for part in (c.isNull(), c)))]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in ``order`` (``-column`` is descending).

    Spark limits each map partition to one row per key ahead of the shuffle, so
    a key's copies never meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*_sort_columns(df, order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def audited(df: DataFrame, date: str, run_timestamp: Column | None = None) -> DataFrame:
    """Audit columns. ``_source_file`` must come from the scan; null if it did not."""
    stamp = F.current_timestamp() if run_timestamp is None else run_timestamp
    source = F.col("_source_file") if "_source_file" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "_ingestion_timestamp": stamp,
            "_source_file": source,
            "_processing_date": F.lit(date),
        }
    )


@dataclass(frozen=True)
class Extraction:
    """One run of an extractor: which system it read, and when. The id tells runs apart."""

    source_system: str
    extraction_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    extracted_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def on(self, df: DataFrame) -> DataFrame:
        """``df`` with the run on every row."""
        return df.withColumns(
            {
                "extracted_at": F.lit(self.extracted_at).cast("timestamp"),
                "source_system": F.lit(self.source_system),
                "extraction_id": F.lit(self.extraction_id),
            }
        )


def without_extractions(df: DataFrame, *extraction_ids: str) -> DataFrame:
    """``df`` without the rows of runs that are withdrawn; rows of no run stay."""
    withdrawn = F.coalesce(F.col("extraction_id").isin(*extraction_ids), F.lit(False))
    return df.where(~withdrawn)
