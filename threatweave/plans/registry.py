"""Queries of the domain's operators over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Derived and given tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return domain.table(self._spark, self._dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where SQL can express it, the SQL over the same tables."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = domain.oracle(sql)
        return fn

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g21_merged_indicators"](spark, sf_dir)


from . import queries_joins, queries_library, queries_provenance, queries_records, queries_rollups, queries_state, queries_stix, queries_stored, queries_streams, queries_text  # noqa: E402, F401
