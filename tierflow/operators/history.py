"""Slowly changing dimensions of type 2, with half-open validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tierflow.functions.keys import unambiguous
from tierflow.operators.joins import null_safe_join
from tierflow.operators.ordered import SLICE, last_known, next_value, previous_value, slice_rows


def surrogate_key(*columns: str | Column) -> Column:
    """Stable key from the business key, the same in every job and run."""
    return F.sha2(unambiguous(*columns), 256)


def _versions(rows: DataFrame, key: str, tracked: Sequence[str], order: Sequence[str], slices: int | None) -> DataFrame:
    """The rows at which ``tracked`` changes, the first element of ``order`` being the time."""
    sliced = slice_rows(rows.withColumn("_seen", F.lit(1)), [key], order, slices)
    known = sliced.withColumn("_state", F.struct("_seen", *tracked))
    previous = previous_value(known, [key], order, "_state", "_previous")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"_previous.{c}"))
    changed = previous.where(F.col("_previous").isNull() | ~same)
    ended = next_value(changed, [key], order, order[0], "valid_to")
    return ended.select(
        key,
        *tracked,
        F.col(order[0]).alias("valid_from"),
        "valid_to",
        F.col("valid_to").isNull().alias("is_current"),
    )


def scd2_build(
    changes: DataFrame, key: str, tracked: str, timestamp: str, tie_break: str, slices: int | None = None
) -> DataFrame:
    """History of ``tracked`` per ``key``: one row per change with ``valid_from``, ``valid_to``
    (null while current) and ``is_current``. A null attribute is a value like any other."""
    rows = changes.where(F.col(key).isNotNull()).select(key, tracked, timestamp, tie_break)
    return _versions(rows, key, [tracked], [timestamp, tie_break], slices)


def scd2_merge(
    history: DataFrame,
    batch: DataFrame,
    key: str,
    tracked: Sequence[str],
    timestamp: str,
    tie_break: str,
    slices: int | None = None,
) -> DataFrame:
    """``history`` after a batch of changes, with every version of the batch at its time, late
    ones between those that are known.

    Keys that the batch does not touch stay as they are and take no part in the ordering. A
    change that the history already has is passed over, so that running it twice with one batch
    changes nothing more. At one instant, known versions come before new ones.
    """
    columns = [key, *tracked, "valid_from", "valid_to", "is_current"]
    history, batch = history.select(*columns), batch.where(F.col(key).isNotNull())
    touched_keys = batch.select(key).distinct()
    touched = history.join(touched_keys, key, "left_semi")
    # An open end sorts behind all others of its instant.
    known = touched.select(
        key,
        *tracked,
        F.col("valid_from").alias("_at"),
        F.lit(0).alias("_new"),
        F.struct(F.col("valid_to").isNull().alias("open"), F.col("valid_to").alias("end")).alias("_rank"),
        F.lit(None).cast(batch.schema[tie_break].dataType).alias("_tie"),
    )
    incoming = batch.select(key, *tracked, F.col(timestamp).alias("_at"), F.col(tie_break).alias("_tie"))
    version = ["_at", *tracked]
    fresh = null_safe_join(incoming, known.select(key, *version).distinct(), [key, *version], "left_anti")
    rows = known.unionByName(
        fresh.withColumns({"_new": F.lit(1), "_rank": F.lit(None).cast(known.schema["_rank"].dataType)})
    )
    merged = _versions(rows, key, tracked, ["_at", "_new", "_rank", "_tie"], slices)
    return history.join(touched_keys, key, "left_anti").unionByName(merged.select(*columns))


def scd2_asof(
    facts: DataFrame,
    history: DataFrame,
    key: str,
    timestamp: str,
    tie_break: str,
    attributes: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """Facts with the attributes valid at their time: ``valid_from <= time < valid_to``.

    Facts and versions are merged into one order and each fact takes the last
    version before it, so that a key with many facts and many versions costs their
    sum and not their product. Intervals of a key must not overlap.
    """
    # A version sorts ahead of the facts of the same instant. Empty intervals hold no fact.
    versions = history.where(
        F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))
    ).select(
        F.col(key),
        F.col("valid_from").alias("_at"),
        F.lit(0).alias("_is_fact"),
        F.lit(None).cast(facts.schema[tie_break].dataType).alias("_tie"),
        F.struct(F.col("valid_to"), *(F.col(a) for a in attributes)).alias("_version"),
        F.lit(None).cast(facts.schema).alias("_fact"),
    )
    events = facts.where(F.col(key).isNotNull()).select(
        F.col(key),
        F.col(timestamp).alias("_at"),
        F.lit(1).alias("_is_fact"),
        F.col(tie_break).alias("_tie"),
        F.lit(None).cast(versions.schema["_version"].dataType).alias("_version"),
        F.struct(*facts.columns).alias("_fact"),
    )
    order = ["_at", "_is_fact", "_tie"]
    merged = versions.unionByName(events)
    sliced = slice_rows(merged, [key], order, slices)
    found = last_known(sliced, [key], order, "_version", "_valid").where("_is_fact = 1")
    valid = F.col("_valid.valid_to").isNull() | (F.col("_at") < F.col("_valid.valid_to"))
    return found.select("_fact.*", *(F.when(valid, F.col(f"_valid.{a}")).alias(a) for a in attributes)).drop(SLICE)
