"""Registered queries and their SQL; ``loomspace.catalog`` gathers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add
