"""Registered queries and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from ..sources.fixtures import duckdb_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The same by their parts: functions of a catalog, and SQL that names tables in braces.
FUNCTIONS: dict[str, Callable[[Catalog], DataFrame]] = {}
TEXTS: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of a catalog under its name; sql names tables as ``{table}``."""

    def register(f: Callable[[Catalog], DataFrame]):
        FUNCTIONS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            TEXTS[f.__name__] = sql
            ORACLE_SQL[f.__name__] = duckdb_query(sql)
        return f

    return register


def load() -> None:
    from . import annotate, browse, filters, grammar, groups, joins, resolve, scans  # noqa: F401
