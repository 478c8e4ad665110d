"""Several values as one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unambiguous(*columns: str | Column) -> Column:
    """Values as one text that no other values give: each with its length, null by a mark."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts))
