"""Marts kept up to date from changed rows, with retractions.

A batch of changes comes as images: each row as it was, with a sign of -1, and as it is, with +1. Counts and sums follow by adding signed
values. For distinct counts and extremes the mart keeps how often each value occurs in a group: a value whose count falls
to zero is gone, and another one becomes the smallest or the largest. Only groups that a batch touches are
looked at, and both tables are appended to by key buckets, so that a batch costs its own size and the rows of its groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierflow.operators.joins import null_safe_join
from tierflow.operators.load import read_buckets, upsert_buckets
from tierflow.operators.sinks import target_exists
from tierflow.workspace import durable

SIGN, VERSION = "_sign", "_version"


@dataclass(frozen=True)
class Mart:
    """A row for each value of ``keys``: ``n_rows``, exact ``sums`` (name: column; decimals and whole numbers), numbers of ``distinct``
    values (name: column), and ``extremes`` (name: ("min" or "max", column))."""

    keys: tuple[str, ...]
    sums: Mapping[str, str] = field(default_factory=dict)
    distinct: Mapping[str, str] = field(default_factory=dict)
    extremes: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def counted_columns(self) -> list[str]:
        """Columns whose values are counted, each once."""
        return list(dict.fromkeys([*self.distinct.values(), *(c for _, c in self.extremes.values())]))


def images(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Rows as they were and as they are, with their sign. Inserted rows have no image before, deleted ones none after."""
    signed = [df.withColumn(SIGN, F.lit(sign)) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


def _measures(rows: DataFrame, mart: Mart) -> DataFrame:
    signed = [F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col(SIGN)).alias(name) for name, c in mart.sums.items()]
    return rows.groupBy(*mart.keys).agg(F.sum(SIGN).cast("long").alias("n_rows"), *signed)


def _references(rows: DataFrame, mart: Mart, column: str) -> DataFrame:
    found = rows.where(F.col(column).isNotNull()).groupBy(*mart.keys, F.col(column).alias("value"))
    return found.agg(F.sum(SIGN).cast("long").alias("refs"))


def _added(old: DataFrame, delta: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The rows of ``old`` that ``delta`` touches, with its values added; new ones as they are."""
    touched = null_safe_join(old, delta.select(*keys), keys, "left_semi").select(*keys, *names)
    both = touched.unionByName(delta.select(*keys, *names))
    return both.groupBy(*keys).agg(*(F.sum(c).cast(delta.schema[c].dataType).alias(c) for c in names))


def _append(changed: DataFrame, known: DataFrame, at: str, keys: Sequence[str], version: int, buckets: int | None) -> None:
    if known.where(F.col(VERSION) >= version).isEmpty():
        upsert_buckets(changed, at, keys, [f"-{VERSION}"], buckets)


def _table(path: str, name: str) -> str:
    return f"{path}/{name}"


def maintain(rows: DataFrame, mart: Mart, path: str, version: int, buckets: int | None = None) -> None:
    """A batch of images added to the mart at ``path``. Versions rise from batch to batch; one that the mart already has is passed
    over, and so is a table of it that a run which broke off had already written: a batch that is repeated changes nothing."""
    spark = rows.sparkSession
    done = _table(path, "versions")
    if target_exists(spark, done) and not spark.read.parquet(done).where(F.col(VERSION) >= version).isEmpty():
        return
    rows = durable(rows.select(*dict.fromkeys([*mart.keys, *mart.sums.values(), *mart.counted_columns(), SIGN])))
    delta = _measures(rows, mart)
    stamp = F.lit(version).alias(VERSION)
    for i, column in enumerate(mart.counted_columns()):
        changed = _references(rows, mart, column)
        at, keys = _table(path, f"values-{i}"), [*mart.keys, "value"]
        known = read_buckets(spark, at, T.StructType([*changed.schema.fields, T.StructField(VERSION, T.IntegerType())]))
        _append(_added(known, changed, keys, ["refs"]).select("*", stamp), known, at, keys, version, buckets)
    at = _table(path, "measures")
    known = read_buckets(spark, at, T.StructType([*delta.schema.fields, T.StructField(VERSION, T.IntegerType())]))
    names = ["n_rows", *mart.sums]
    _append(_added(known, delta, mart.keys, names).select("*", stamp), known, at, mart.keys, version, buckets)
    spark.createDataFrame([(version,)], f"{VERSION} int").write.mode("append").parquet(done)


def read_mart(spark: SparkSession, mart: Mart, path: str, schema: T.StructType) -> DataFrame:
    """The mart at ``path``: a row for each group that has rows. ``schema`` is that of the source's rows."""
    empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(SIGN, T.IntegerType())]))
    version = T.StructField(VERSION, T.IntegerType())
    result = read_buckets(spark, _table(path, "measures"), T.StructType([*_measures(empty, mart).schema.fields, version]))
    result = result.where("n_rows > 0").drop(VERSION)
    for i, column in enumerate(mart.counted_columns()):
        fields = _references(empty, mart, column).schema.fields
        held = read_buckets(spark, _table(path, f"values-{i}"), T.StructType([*fields, version])).where("refs > 0")
        wanted = [F.count("value").alias(name) for name, c in mart.distinct.items() if c == column]
        wanted += [(F.min if kind == "min" else F.max)("value").alias(name) for name, (kind, c) in mart.extremes.items() if c == column]
        result = null_safe_join(result, held.groupBy(*mart.keys).agg(*wanted), mart.keys, "left")
    return result.fillna(0, subset=list(mart.distinct)) if mart.distinct else result


def full_build(rows: DataFrame, mart: Mart) -> DataFrame:
    """The mart from all rows at once."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in mart.sums.items()]
    distinct = [F.count_distinct(c).alias(name) for name, c in mart.distinct.items()]
    extremes = [(F.min if kind == "min" else F.max)(c).alias(name) for name, (kind, c) in mart.extremes.items()]
    return rows.groupBy(*mart.keys).agg(F.count("*").alias("n_rows"), *sums, *distinct, *extremes)
