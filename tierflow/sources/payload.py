"""Records out of REST response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Wrapper keys, tried in this order.
WRAPPER_KEYS = ("data", "results", "items")


def record_array(body: Column) -> Column:
    """The records of a parsed body: a bare array's elements, the first list below a wrapper
    key, or the body itself as the only record. Null for an unparsed body.

    Reading a value as an array gives null for anything that is none, so text
    such as ``"[1]"`` is no list.
    """
    paths = ("$", *(f"$.{key}" for key in WRAPPER_KEYS))
    lists = [F.try_variant_get(body, path, "array<variant>") for path in paths]
    return F.coalesce(*lists, F.when(body.isNotNull(), F.array(body)))


def unwrap_payload(responses: DataFrame, body: str = "body", record: str = "record") -> DataFrame:
    """One row per record, as variant in ``record``. Unparseable bodies yield no row."""
    parsed = responses.withColumn("_parsed", F.try_parse_json(body))
    return parsed.select(
        *[c for c in responses.columns if c != body],
        F.explode(record_array(F.col("_parsed"))).alias(record),
    )


def unparseable(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses whose body is missing or no JSON, for quarantine."""
    return responses.where(F.try_parse_json(body).isNull())


def count_records(body: Column) -> Column:
    """Number of records in a response body; 0 where it does not parse."""
    return F.coalesce(F.size(record_array(F.try_parse_json(body))), F.lit(0))
