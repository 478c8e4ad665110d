"""Joins that stay balanced when keys are missing, hot or few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

NULL_SPREAD = 1024
#: Rows of one key on one side that meet those of the other in one task, about.
BLOCK_ROWS = 5_000
#: Rows of the larger side of a join that one task sorts, about.
TASK_ROWS = 500_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*(f"_right_{k}" for k in keys))


def with_group_stats(df: DataFrame, keys: Sequence[str], *stats: Column) -> DataFrame:
    """Group aggregates on every row, like ``agg over (partition by keys)`` but with map-side
    partial sums, so that one group may hold most of the rows. Null keys form a group."""
    return null_safe_join(df, df.groupBy(*keys).agg(*stats), keys, "left")


def dealt(sides: Sequence[tuple[DataFrame, str]], rows: int) -> list[DataFrame]:
    """Sides (frame, key) of an inner join hashed by key to so many partitions that each has about ``TASK_ROWS`` of the larger
    side's ``rows``; what a task sorts and aggregates by key then does not grow with the table. Null keys, which match nothing,
    go before; a side of no more rows than that is left as it is."""
    parts = -(-rows // TASK_ROWS)
    if parts <= 1:
        return [df for df, _ in sides]
    parts = max(parts, int(sides[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [df.where(F.col(key).isNotNull()).repartition(parts, key) for df, key in sides]


def left_join_spread(left: DataFrame, right: DataFrame, key: str, right_key: str, spread_on: str) -> DataFrame:
    """Left join on one key that may be null on the left for many rows: null keys, which match
    nothing, are spread by ``spread_on`` rather than sent to one task."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_on), F.lit(NULL_SPREAD)) + 1)
    salted = left.withColumn("_spread", F.coalesce(spread, F.lit(0)))
    target = right.withColumn("_spread_right", F.lit(0).cast("long"))
    joined = salted.join(
        target,
        (F.col(key) == F.col(right_key)) & (F.col("_spread") == F.col("_spread_right")),
        "left",
    )
    return joined.drop("_spread", "_spread_right")


def join_in_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_left: str, spread_right: str, block_rows: int | None = None
) -> DataFrame:
    """Inner join in which a key with many rows on both sides is cut into blocks of about ``block_rows`` on either side, by a hash
    of the ``spread`` columns; every two blocks meet under a key of their own, and so in tasks of their own."""
    block_rows = block_rows or BLOCK_ROWS
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_n"), (right, "_m"))]
    hot = counts[0].join(counts[1], list(keys)).where(F.col("_n").cast("double") * F.col("_m") > float(block_rows) ** 2)
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    hot = hot.select(*keys, blocks("_n").alias("_rows"), blocks("_m").alias("_columns"))

    def dealt(df: DataFrame, spread: str, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        known = df.join(hot, list(keys), "left")
        place = F.coalesce(F.pmod(F.xxhash64(spread, F.lit(1)), F.col(own)).cast("int"), F.lit(0))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return known.withColumn(own_name, place).withColumn(other_name, copies).drop("_rows", "_columns")

    a = dealt(left, spread_left, "_rows", "_columns", "_i", "_j")
    b = dealt(right, spread_right, "_columns", "_rows", "_j", "_i")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def integrate(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Cross-source equi-join. Spark broadcasts the smaller side if its size allows."""
    if how not in ("inner", "left", "left_semi", "left_anti", "full"):
        raise ValueError(f"unsupported join: {how}")
    return left.join(right, on, how)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right, on, "left_anti")
