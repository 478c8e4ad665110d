"""Profiles that add up: states per day and column that are stored, merged and read at any grain.

A state holds exact counts, extremes and decimal sums, a HyperLogLog sketch of the distinct values, and for numbers a KLL sketch of the
quantiles. A new day costs its own rows; a profile of any days merges their states and reads no old row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tierflow.operators.sinks import write_partitions

#: log2 of the registers of a distinct sketch: a relative deviation of about 1.04 / sqrt(2**12) = 1.6 %.
HLL_BITS = 12
#: Size of a quantile sketch: ranks within about 0.9 % with a probability of 99 %.
KLL_SIZE = 300
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.02


def _entry(df: DataFrame, column: str, scale: int):
    """The state of one column as a struct; what does not apply to its type is null."""
    kind = df.schema[column].dataType
    numeric = isinstance(kind, T.NumericType)
    x = F.col(column).cast("double")
    hashable = kind if isinstance(kind, (T.StringType, T.BinaryType, T.LongType, T.IntegerType)) else None
    # Sketches take whole numbers and text; other types go by their text, which tells their values apart.
    distinct = F.col(column) if hashable else F.col(column).cast("string")
    null = lambda t: F.lit(None).cast(t)
    text = isinstance(kind, (T.StringType, T.BinaryType))
    return F.struct(
        F.lit(column).alias("column"),
        F.count("*").alias("rows"),
        F.count(column).alias("count"),
        (F.min(x) if numeric else null("double")).alias("min"),
        (F.max(x) if numeric else null("double")).alias("max"),
        (F.sum(F.col(column).cast(f"decimal(28,{scale})")).cast("decimal(38,4)") if numeric else null("decimal(38,4)")).alias("sum"),
        (null("long") if not text else F.max(F.length(column)).cast("long")).alias("longest"),
        F.hll_sketch_agg(distinct, F.lit(HLL_BITS)).alias("distinct_sketch"),
        (F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)) if numeric else null("binary")).alias("quantile_sketch"),
    )


def profile_states(df: DataFrame, day: str, columns: Sequence[str], scale: int = 4) -> DataFrame:
    """Rows (day, column, state …): one partial aggregation over ``df``. Decimal sums are exact to ``scale`` places."""
    entries = df.groupBy(F.col(day).alias("day")).agg(*(_entry(df, c, scale).alias(f"_{i}") for i, c in enumerate(columns)))
    return entries.select("day", F.inline(F.array(*(F.col(f"_{i}") for i in range(len(columns))))))


def add_states(df: DataFrame, path: str, day: str, columns: Sequence[str], scale: int = 4) -> None:
    """States of the days that ``df`` holds, written in place of what ``path`` has of these days."""
    write_partitions(profile_states(df, day, columns, scale), path, ["day"])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_profile(states: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """Profiles of the merged ``states``, a row for each column (and each value of ``by``): exact ``rows``, ``count``, ``min``, ``max``,
    ``sum`` and ``longest``, and within the sketches' error ``n_distinct`` and the quantiles ``q25``, ``q50`` …"""
    merged = states.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("count").alias("count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("sum"),
        F.max("longest").alias("longest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("_sketch"),
    )
    filled = F.coalesce(F.kll_sketch_get_n_double("_sketch"), F.lit(0)) > 0
    at = [F.when(filled, F.kll_sketch_get_quantile_double("_sketch", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select("*", *at).drop("_sketch")
