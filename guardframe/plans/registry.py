"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardframe.functions.dialect import sql_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(data, schema)


def values(columns: str, data: list[tuple]) -> str:
    """The same literal table in SQL."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(lit, x)) + "]"
        if isinstance(x, dict):
            return "{" + ", ".join(f"'{k}': {lit(v)}" for k, v in x.items()) + "}"
        return repr(x) if isinstance(x, (int, float)) else sql_text(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data) + f") AS f({columns})"
