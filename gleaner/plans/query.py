"""How queries are registered: a function (spark, sf_dir) -> DataFrame beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register the function under its name; `sql` is DuckDB's way to the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: object) -> str:
    """A value as an SQL literal."""
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def values(columns: str, rows: list[tuple]) -> str:
    """SELECT over literal rows."""
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"
