"""Comparison of a Spark result with DuckDB's, column by column and value by value."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(repr(row[i]) for i in order) for row in rows)
    )


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    relation = connection.sql(sql)
    expected_types = dict(zip(relation.columns, (str(t) for t in relation.types)))
    rows = [tuple(r) for r in spark_df.collect()]
    columns, actual = _sorted(spark_df.columns, rows)
    wanted_columns, expected = _sorted(relation.columns, relation.fetchall())
    found = []
    if columns != wanted_columns:
        return [f"columns {columns} != {wanted_columns}"]
    for name, kind in spark_df.dtypes:
        wanted = TYPES.get(kind, kind.upper().replace(",", ", "))
        if expected_types[name].replace(" ", "") != wanted.replace(" ", ""):
            found.append(f"type of {name}: {kind} != {expected_types[name]}")
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows != {len(expected)}")
    if actual != expected:
        ours, theirs = set(actual) - set(expected), set(expected) - set(actual)
        found.append(f"{len(ours)} rows only ours, e.g. {sorted(ours)[:2]}; {len(theirs)} theirs, e.g. {sorted(theirs)[:2]}")
    return found
