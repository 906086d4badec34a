"""The query registry and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests only."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part of a table that is dealt anew.
PART_ROWS = 500_000


def dealt_anew(df: DataFrame, rows: int, least: int, *keys: str) -> DataFrame:
    """``df`` in another order, in as many parts as its number of rows needs, but at least so many."""
    return df.repartition(max(least, -(-rows // PART_ROWS)), *keys)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
