"""Queries of this subpackage, each next to the SQL that must give the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key, with its SQL if there is one."""

    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, folder: function(spark, str(folder).rstrip("/"))
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register
