"""How queries are registered: a function over (spark, directory), with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: DuckDB's form of functions.text.strip(), written STRIP(x) in the queries' SQL.
_BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def expand(sql: str) -> str:
    return re.sub(r"STRIP\(([^()]+)\)", lambda m: f"regexp_replace({m[1]}, '^{_BLANKS}|{_BLANKS}$', '', 'g')", sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name; sql is DuckDB's equivalent over the same tables."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = expand(sql)
        return function

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")
