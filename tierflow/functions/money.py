"""Exact money arithmetic on double columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(value: Column) -> Column:
    """A double amount as a two-digit decimal, so that sums do not depend on their order."""
    return value.cast("decimal(12,2)")


def exact_sum(value: Column) -> Column:
    """Sum of a decimal column, as double."""
    return F.sum(value).cast("double")


def exact_mean(value: Column) -> Column:
    """Mean of a decimal column; null for no values."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
