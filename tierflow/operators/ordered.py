"""Ordered computations whose groups may be too large for one task.

``slice_rows`` range-partitions rows on (keys, order) into slices of about equal
size, however the keys are distributed: a key with a third of all rows covers a
third of the slices. Windows then run per slice and key. What crosses a slice
border comes from the last or first row of the neighbouring slice, in a table of
one row per slice that is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow.operators.joins import null_safe_join
from tierflow.workspace import durable

SLICE = "_slice"


def _ranged(df: DataFrame, slices: int | None, *columns: str | Column) -> DataFrame:
    """Range partitions: a given number, or at most ``spark.sql.shuffle.partitions`` of which
    adaptive execution joins small ones."""
    return df.repartitionByRange(slices, *columns) if slices else df.repartitionByRange(*columns)


def slice_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None
) -> DataFrame:
    """``df`` with a stable ``_slice``. ``order`` should tell the rows of a key apart, since equal
    rows stay together; null keys are one key. The result is durable because slice borders
    come from a sample and must be the same for every reader."""
    ranged = _ranged(df, slices, *keys, *order)
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def _in_slice(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(SLICE, *keys).orderBy(*order)


def _same_key(keys: Sequence[str], edge: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{edge}.{k}"))
    return condition


def previous_value(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``lag(value)`` over the key, in ``name``; null on the key's first row."""
    tails = sliced.groupBy(SLICE).agg(
        F.max_by(F.struct(*keys, value), F.struct(*keys, *order)).alias("_tail")
    )
    before = tails.select(SLICE, F.lag("_tail").over(Window.orderBy(SLICE)).alias("_before"))
    windowed = sliced.withColumn("_in", F.lag(F.struct(value)).over(_in_slice(keys, order)))
    border = F.when(_same_key(keys, "_before"), F.struct(F.col("_before")[value].alias(value)))
    joined = windowed.join(F.broadcast(before), SLICE)
    return joined.withColumn(name, F.coalesce("_in", border)[value]).drop("_in", "_before")


def next_value(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``lead(value)`` over the key, in ``name``; null on the key's last row. ``rows`` may be any
    part of the sliced rows; what it takes to compute them is done once."""
    windowed = durable(rows.withColumn("_in", F.lead(F.struct(value)).over(_in_slice(keys, order))))
    heads = windowed.groupBy(SLICE).agg(
        F.min_by(F.struct(*keys, value), F.struct(*keys, *order)).alias("_head")
    )
    after = heads.select(SLICE, F.lead("_head").over(Window.orderBy(SLICE)).alias("_after"))
    border = F.when(_same_key(keys, "_after"), F.struct(F.col("_after")[value].alias(value)))
    joined = windowed.join(F.broadcast(after), SLICE)
    return joined.withColumn(name, F.coalesce("_in", border)[value]).drop("_in", "_after")


def last_known(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Latest non-null ``value`` up to and including each row, in ``name``."""
    known = F.col(value).isNotNull()
    # Of the slice's last key: the latest row with a value, else any.
    tails = sliced.groupBy(SLICE).agg(
        F.max_by(F.struct(*keys, value), F.struct(*keys, known, *order)).alias("_tail")
    )
    by_key = Window.partitionBy(*(F.col("_tail")[k] for k in keys)).orderBy(SLICE)
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = tails.select(
        SLICE,
        F.struct(
            *(F.col("_tail")[k].alias(k) for k in keys),
            F.last(F.col("_tail")[value], ignorenulls=True).over(upto).alias(value),
        ).alias("_running"),
    )
    before = running.select(SLICE, F.lag("_running").over(Window.orderBy(SLICE)).alias("_before"))
    w = _in_slice(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = sliced.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    border = F.when(_same_key(keys, "_before"), F.col("_before")[value])
    joined = windowed.join(F.broadcast(before), SLICE)
    return joined.withColumn(name, F.coalesce("_in", border)).drop("_in", "_before")


def running_total(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Running sum of a non-null ``value`` over the key, in ``name``."""
    parts = sliced.groupBy(SLICE, *keys).agg(F.sum(value).alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a slice can have begun in an earlier one: at most a row per slice.
    carried = parts.select(SLICE, *keys, F.sum("_part").over(earlier).alias("_before")).where(
        "_before IS NOT NULL"
    )
    w = _in_slice(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = sliced.withColumn("_in", F.sum(value).over(w))
    joined = null_safe_join(windowed, F.broadcast(carried), [SLICE, *keys], "left")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_in")).drop("_in", "_before")


def numbered(
    df: DataFrame, order: Sequence[str | Column], name: str, total: str, slices: int | None = None
) -> DataFrame:
    """Row number 1, 2, … over the whole table in ``order``, and the row count.

    Rows are numbered inside sorted range partitions; the offsets of the
    partitions are one row each and broadcast.
    """
    placed = durable(
        _ranged(df, slices, *order)
        .sortWithinPartitions(*order)
        .withColumn(SLICE, F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy(SLICE).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        SLICE,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    return (
        placed.join(F.broadcast(offsets), SLICE)  # at most one row per slice
        .withColumn(name, F.col("_offset") + F.col("_place") + 1)
        .drop(SLICE, "_place", "_offset")
    )


def ntile(df: DataFrame, buckets: int, order: Sequence[str | Column], name: str) -> DataFrame:
    """``ntile(buckets)`` over the whole table without a single-task window."""
    rows = numbered(df, order, "_rn", "_rows")
    rn, small = F.col("_rn"), F.floor(F.col("_rows") / buckets).cast("long")
    larger = F.col("_rows") % buckets
    border = larger * (small + 1)
    bucket = F.when(rn <= border, F.floor((rn - 1) / (small + 1)) + 1).otherwise(
        larger + F.floor(F.try_divide(rn - border - 1, small)) + 1
    )
    return rows.withColumn(name, bucket.cast("int")).drop("_rn", "_rows")


#: Rows of the sample that splitters are taken from, and rows that are put in order by one task.
SPLITTERS, ORDERED_ROWS = 24, 1_000_000
# An order: columns with whether they descend. Nulls are smaller than all values.
Order = Sequence[tuple[str, bool]]


def ntiles(df: DataFrame, buckets: int, orders: Mapping[str, Order]) -> DataFrame:
    """``ntile(buckets)`` over the whole table for several orders at once, each in a column of its own. An order tells all
    rows apart.

    Nothing is sorted as a whole: a sample gives splitters of every order, one pass counts the rows between them, and only slices in
    which a bucket begins are looked at further. Buckets then follow from their first rows, of which there are ``buckets`` for
    each order. ``df`` is read a few times; make it durable if it is dear.
    """
    columns = sorted({c for order in orders.values() for c, _ in order})
    rows = df.select(*columns)
    splitters = {name: _splitters(rows, order) for name, order in orders.items()}
    place = {name: _place(order, splitters[name]) for name, order in orders.items()}
    counts = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("order"), place[n].alias("slice")) for n in orders))))
    held = {(r["order"], r["slice"]): r["n"] for r in counts.groupBy("order", "slice").agg(F.count("*").alias("n")).collect()}
    first_order = next(iter(orders))
    total = sum(n for (name, _), n in held.items() if name == first_order)
    small, larger = divmod(total, buckets)
    firsts = sorted({start for b in range(1, buckets) if 0 < (start := b * small + min(b, larger)) < total})

    borders = {}
    for name, order in orders.items():
        sizes = [held.get((name, at), 0) for at in range(len(splitters[name]) + 1)]
        wanted = [_slice_of(sizes, first) for first in firsts]
        near = rows.withColumn("_at", place[name]).where(F.col("_at").isin(sorted({at for at, _ in wanted})))
        found = {}
        if few := [w for w in wanted if sizes[w[0]] <= ORDERED_ROWS]:
            by_order = Window.partitionBy("_at").orderBy(*_sorted(order))
            ranked = near.withColumn("_rank", F.row_number().over(by_order) - 1)
            hit = reduce(or_, ((F.col("_at") == at) & (F.col("_rank") == rank) for at, rank in few))
            found = {(r["_at"], r["_rank"]): r for r in ranked.where(hit).collect()}
        for at, rank in wanted:
            if (at, rank) not in found:
                found[at, rank] = _row_at(near.where(F.col("_at") == at), order, rank, sizes[at])
        borders[name] = [found[w] for w in wanted]
    return df.select("*", *((_place(order, borders[name]) + 1).alias(name) for name, order in orders.items()))


def _sorted(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c, descending in order]


def _splitters(rows: DataFrame, order: Order) -> list:
    """Rows of a sample by row hash, in order, each once."""
    names = [c for c, _ in order]
    chosen = rows.select(*names).orderBy(F.xxhash64(*names, F.lit(3))).limit(SPLITTERS).distinct()
    return chosen.orderBy(*_sorted(order)).collect()


def _slice_of(sizes: Sequence[int], rank: int) -> tuple[int, int]:
    """The slice that holds the row of a rank (from 0), and its rank there."""
    at = 0
    while rank >= sizes[at]:
        rank -= sizes[at]
        at += 1
    return at, rank


def _row_at(rows: DataFrame, order: Order, rank: int, n: int):
    """The row of a rank (from 0) among ``n``: slices of slices, until one task can put the rest in order."""
    while n > ORDERED_ROWS:
        place = _place(order, splitters := _splitters(rows, order))
        counts = {r["slice"]: r["n"] for r in rows.groupBy(place.alias("slice")).agg(F.count("*").alias("n")).collect()}
        sizes = [counts.get(at, 0) for at in range(len(splitters) + 1)]
        at, rank = _slice_of(sizes, rank)
        rows, n = rows.where(place == at), sizes[at]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_sorted(order))) - 1)
    return ranked.where(F.col("_rank") == rank).first()


def _place(order: Order, borders: Sequence) -> Column:
    """How many of the sorted ``borders`` (rows) a row is not before, by a tree of comparisons."""

    def reached(border) -> Column:
        condition = F.lit(True)
        for name, descending in reversed(order):
            column, value = F.col(name), border[name]
            if value is None:
                beyond, same = (F.lit(False) if descending else column.isNotNull()), column.isNull()
            else:
                beyond = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
                same = column == F.lit(value)
            condition = F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & condition)
        return condition

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(reached(borders[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return below(0, len(borders))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], slices: int | None = None
) -> DataFrame:
    """Linearly interpolated percentiles of ``value`` per key, one column per entry of
    ``points``. Equal values are counted before the sort; no group is held in one task."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_n"))
    )
    sliced = slice_rows(counted, keys, [value], slices)
    totals = sliced.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    running = running_total(sliced, keys, [value], "_n", "_upto")
    ranked = null_safe_join(running, totals, keys)
    upto, first = F.col("_upto"), F.col("_upto") - F.col("_n")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < upto), F.col(value)))

    columns = []
    for name, p in points.items():
        position = F.lit(p) * (F.col("_rows") - 1)
        columns += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
        ]
    bounds = ranked.groupBy(*keys).agg(*columns, F.max("_rows").alias("_rows"))
    interpolated = []
    for name, p in points.items():
        position = F.lit(p) * (F.col("_rows") - 1)
        share = position - F.floor(position)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        interpolated.append((lo + (hi - lo) * share).alias(name))
    return bounds.select(*keys, *interpolated)
