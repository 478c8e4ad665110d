"""Casts that turn bad input into null, also when ANSI mode is on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_FRACTION = r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)$"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def lenient_int(value: Column, target: T.DataType) -> Column:
    """String to an integral type: ``'12.7'`` gives 12, ``'1e3'`` and ``'abc'`` give null."""
    text = F.trim(value)
    truncated = value.try_cast(T.DecimalType(38, 18)).try_cast(target)
    return F.coalesce(value.try_cast(target), F.when(text.rlike(_FRACTION), truncated))


def lenient_cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` as ``target``, null where it does not fit."""
    if isinstance(source, T.StringType) and isinstance(target, _INTEGRAL):
        return lenient_int(value, target)
    return value.try_cast(target)
