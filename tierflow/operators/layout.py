"""Tables clustered by several columns at once along a space-filling curve.

Each column's values are replaced by their range rank among ``2**bits`` ranges of about as many rows, and the ranks' bits are
interleaved (Z-order). Rows of one place of the curve are a cell. Cells are counted, and the space of all is halved in every column for as long as
a box has too many rows for a file; so each file is a box, with a narrow range of every column, and not a stretch of the
curve, which may jump. A cell that fills several files is dealt to partitions by row hash; where a file is small for a task, a partition holds
several files of its cell, which the writer cuts off; the last one may be small. By the minima and maxima that Parquet keeps, a filter
on a narrow range of any one of k columns opens one or two of the files' k-th root of layers.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierflow.operators.sinks import directory_bytes, directory_files

BITS = 6
#: Bits of a place on the curve, and so of the number of cells that are counted on the driver.
CELL_BITS = 16
#: Times its even share that a box may hold before it is divided.
SLACK = 1.5
#: Rows that borders are taken from, for each range of a column.
SAMPLED = 100
#: A task writes several files of a cell while they are below this together, and at most so many.
TASK_BYTES = 128 * 1024 * 1024
TASK_FILES = 64


def range_borders(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """The upper borders between ``2**bits`` ranges of each column, from a sample by row hash: at most
    ``SAMPLED`` rows for each range come to the driver. Any type that sorts will do."""
    ranges = 1 << bits
    present = df.select(*columns)
    # A row is chosen by its own hash, so that a lost task chooses the same rows again.
    chosen = present.orderBy(F.xxhash64(*columns, F.lit(7))).limit(SAMPLED * ranges).collect()
    borders = {}
    for k, name in enumerate(columns):
        values = sorted(r[k] for r in chosen if r[k] is not None)
        picked = [values[i * len(values) // ranges] for i in range(1, ranges)] if values else []
        borders[name] = [v for i, v in enumerate(picked) if i == 0 or v != picked[i - 1]]
    return borders


def range_rank(column: Column, borders: Sequence) -> Column:
    """How many borders are at most the value, by a tree of comparisons; nulls come first."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(borders[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return F.when(column.isNull(), 0).otherwise(below(0, len(borders))).cast("long")


def z_value(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of all ranks interleaved, the highest of each first."""
    value = F.lit(0).cast("long")
    for bit in range(bits):
        for k, rank in enumerate(ranks):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1))
            value = value.bitwiseOR(F.shiftleft(one, bit * len(ranks) + k))
    return value


def boxes(counts: Mapping[int, int], columns: int, bits: int, most: float) -> list[tuple[int, int, int]]:
    """(first cell, end cell, parts) of boxes with at most ``most`` rows, in the order of the curve; a cell with more has several parts.

    A box of level l is what shares the first ``l * columns`` bits of the curve."""
    cells = sorted(counts)
    before = [0, *accumulate(counts[c] for c in cells)]
    found = []

    def divide(first: int, size: int) -> None:
        a, b = bisect_left(cells, first), bisect_left(cells, first + size)
        rows = before[b] - before[a]
        if not rows:
            return
        if rows <= most or size == 1:
            found.append((first, first + size, max(1, math.ceil(rows / most)) if size == 1 else 1))
            return
        for k in range(1 << columns):
            divide(first + k * (size >> columns), size >> columns)

    divide(0, 1 << bits * columns)
    return found


def z_ordered(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """``df`` dealt to about ``files`` partitions, each a box of the curve, and sorted along it inside them.

    Of each column at most ``CELL_BITS / len(columns)`` bits are taken, so that at most ``2**CELL_BITS`` cells are counted."""
    return _dealt(df, columns, files, bits, 1)[0]


def _dealt(df: DataFrame, columns: Sequence[str], files: int, bits: int, together: int) -> tuple[DataFrame, int]:
    """``df`` in partitions that are a box each, or about ``together`` files of one cell, and the rows that a file holds at most.

    So there are at most as many partitions as cells, and one more for each ``together`` files."""
    bits = max(1, min(bits, CELL_BITS // len(columns)))
    borders = range_borders(df, columns, bits)
    placed = df.withColumn("_z", z_value([range_rank(F.col(c), borders[c]) for c in columns], bits))
    counts = {r["_z"]: r["n"] for r in placed.groupBy("_z").agg(F.count("*").alias("n")).collect()}
    most = max(1.0, SLACK * sum(counts.values()) / files)
    planned, rows, number = boxes(counts, len(columns), bits, most), [], 0
    for first, end, parts in planned:
        parts = math.ceil(parts / together)
        rows += [(z, number, parts) for z in range(first, end) if z in counts]
        number += parts
    cells = df.sparkSession.createDataFrame(rows, "_z bigint, _first int, _parts int")
    # At most 2**CELL_BITS rows. The row hash parts what several partitions hold.
    known = placed.join(F.broadcast(cells), "_z")
    partition = (F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_parts"))).cast("int")
    dealt = known.repartitionById(max(1, number), partition)
    return dealt.sortWithinPartitions("_z", *columns).select(*df.columns), int(most)


def compact_z_ordered(
    spark: SparkSession, source: str, target: str, columns: Sequence[str], target_bytes: int = 512 * 1024 * 1024, bits: int = BITS
) -> int:
    """Rewrite of a Parquet directory into files of about ``target_bytes``, each a box of the curve. Returns their number."""
    files = max(1, math.ceil(directory_bytes(spark, source) / target_bytes))
    together = max(1, min(TASK_FILES, TASK_BYTES // target_bytes))
    dealt, most = _dealt(spark.read.parquet(source), columns, files, bits, together)
    writer = dealt.write.mode("errorifexists")
    if together > 1:  # a box that is one file has at most so many rows and is not cut
        writer = writer.option("maxRecordsPerFile", most)
    writer.parquet(target)
    return directory_files(spark, target)


def file_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What each file of a table read by Spark holds: its path, rows, and the range of each column."""
    ranges = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"), *ranges)


def opened_share(df: DataFrame, column: str, low, high) -> DataFrame:
    """One row: how many files a filter on a range of one column has to open, of how many."""
    held = file_ranges(df, [column])
    meets = (F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high))
    return held.agg(F.count_if(meets).alias("opened"), F.count("*").alias("files"))
