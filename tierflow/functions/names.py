"""Column names and storage paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


_SEPARATORS = str.maketrans(" -", "__")


def normalized_name(name: str) -> str:
    """Lower case, with blanks and hyphens as underscores."""
    return name.lower().translate(_SEPARATORS)


def normalized_names(names: Sequence[str], on_collision: str = "raise") -> list[str]:
    """Normalised names in order. ``on_collision="suffix"`` numbers repeated ones."""
    if on_collision not in ("raise", "suffix"):
        raise ValueError(f"unknown on_collision: {on_collision}")
    plain = [normalized_name(n) for n in names]
    repeated = sorted(n for n, k in Counter(plain).items() if k > 1)
    if repeated and on_collision == "raise":
        raise ValueError(f"columns collide after normalisation: {repeated}")
    taken: set[str] = set()
    result = []
    for name in plain:
        candidate, number = name, 1
        while candidate in taken or (number > 1 and candidate in plain):
            number += 1
            candidate = f"{name}_{number}"
        taken.add(candidate)
        result.append(candidate)
    return result


def normalize_columns(df: DataFrame, on_collision: str = "raise") -> DataFrame:
    """All top-level columns renamed in one projection; nested fields keep their names."""
    return df.toDF(*normalized_names(df.columns, on_collision))


def bucket_path(bucket: str, partial: str) -> str:
    """``bucket`` with a scheme is used as is, a bare name is an ``s3a`` bucket."""
    root = bucket if "://" in bucket else f"s3a://{bucket}"
    return f"{root}/{partial}"


def raw_glob(prefix: str, source: str, entity: str, date: str, fmt: str, compressed: bool = True) -> str:
    """Objects of one entity and day; ``compressed`` also picks ``.gz`` twins."""
    return f"{prefix}/{source}/{entity}/*{date}.{fmt}{'*' if compressed else ''}"


def bronze_dir(prefix: str, source: str, entity: str, date: str) -> str:
    """Folder of one entity and day; each source of an entity has its own."""
    return f"{prefix}/{source}/{entity}/{date}/"


# Fixed value: the layout of raw keys.
def raw_key(prefix: str, source: str, entity: str, domain: str, date: str, extension: str) -> str:
    """Object key of one raw file; an empty prefix leaves no leading slash."""
    name = f"{domain}_{source}_{entity}_{date}.{extension}"
    return "/".join(part for part in (prefix, source, entity, name) if part)


def raw_key_column(
    prefix: str, domain: str, source: Column, entity: Column, day: Column, extension: str
) -> Column:
    """:func:`raw_key` per row."""
    date = F.date_format(day, "yyyyMMdd")
    name = F.concat(F.concat_ws("_", F.lit(domain), source, entity, date), F.lit(f".{extension}"))
    parts = [F.lit(prefix)] if prefix else []
    return F.concat_ws("/", *parts, source, entity, name)
