"""Warehouse queries over JDBC, capped with an exact truncation flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Required connection settings and JDBC drivers per kind.
REQUIRED = {
    "postgres": ("host", "port", "database", "user", "password"),
    "snowflake": ("account", "database", "user", "password"),
}
DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
}

FETCH_ROWS = 10_000
ROW_LIMIT = 500


def jdbc_options(kind: str, config: Mapping[str, object]) -> dict[str, str]:
    """Options of Spark's JDBC source from a connection's settings."""
    if kind not in REQUIRED:
        raise ValueError(f"unsupported warehouse kind {kind!r}; expected one of {sorted(REQUIRED)}")
    lacking = [k for k in REQUIRED[kind] if not str(config.get(k) or "").strip()]
    if lacking:
        raise ValueError(f"{kind} settings lack {', '.join(sorted(lacking))}")
    if kind == "postgres":
        url = f"jdbc:postgresql://{config['host']}:{int(config['port'])}/{config['database']}"
        url += f"?sslmode={config.get('sslmode') or 'prefer'}&connectTimeout={int(config.get('connect_timeout') or 5)}"
    else:
        url = f"jdbc:snowflake://{config['account']}.snowflakecomputing.com/?db={config['database']}"
        for key in ("warehouse", "role"):
            if config.get(key):
                url += f"&{key}={config[key]}"
    return {
        "url": url,
        "driver": DRIVERS[kind],
        "user": str(config["user"]),
        "password": str(config["password"]),
        "fetchsize": str(FETCH_ROWS),
    }


def read_table(
    spark: SparkSession,
    kind: str,
    config: Mapping[str, object],
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A table scan; with a numeric column and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").options(**jdbc_options(kind, config)).option("dbtable", table)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()


def read_query(spark: SparkSession, kind: str, config: Mapping[str, object], sql: str) -> DataFrame:
    """A query the warehouse runs; the JDBC source wraps it as a subquery, so only queries pass."""
    return spark.read.format("jdbc").options(**jdbc_options(kind, config)).option("query", sql).load()


def capped(df: DataFrame, limit: int = ROW_LIMIT) -> tuple[list[dict], bool]:
    """At most ``limit`` rows and whether there were more: one extra row is asked for."""
    if limit < 1:
        raise ValueError("the row limit must be positive")
    rows = [row.asDict(recursive=True) for row in df.limit(limit + 1).collect()]
    return rows[:limit], len(rows) > limit


CATALOG_QUERY = (
    "SELECT c.table_schema, c.table_name, c.ordinal_position, c.column_name, c.data_type "
    "FROM information_schema.columns c JOIN information_schema.tables t "
    "ON c.table_schema = t.table_schema AND c.table_name = t.table_name "
    "WHERE t.table_type = 'BASE TABLE'"
)


def warehouse_catalog(spark: SparkSession, kind: str, config: Mapping[str, object]) -> DataFrame:
    """catalog_columns of a warehouse: base tables only."""
    return read_query(spark, kind, config, CATALOG_QUERY).select(
        F.col("table_schema").alias("schema"),
        F.col("table_name").alias("table"),
        F.col("ordinal_position").cast("int").alias("ordinal"),
        F.col("column_name").alias("column"),
        F.col("data_type").alias("type"),
    )
