"""Compare a query with its SQL, row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, connection, sql):
    """The difference between a DataFrame and a SQL text, or ``None``."""
    relation = connection.sql(sql)
    expected_names, expected = relation.columns, relation.fetchall()
    found = df.collect()
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} instead of {sorted(expected_names)}"
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}"
    left, right = rows_of(df.columns, found), rows_of(expected_names, expected)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}"
    types = dict(zip(expected_names, map(str, relation.types)))
    kinds = {
        "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp_ntz",
    }
    odd = {n: (t, types[n]) for n, t in df.dtypes if kinds.get(types[n], types[n]) != t}
    return f"types differ: {odd}" if odd and left else None
