"""The catalog: tables and columns as rows, grants, inventories, feed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom import session
from feedloom.operators.latest import last_per_group
from feedloom.types import logical_type

# Caps of a schema inventory and of its preview.
MAX_TABLES_PER_SCHEMA = 25
MAX_COLUMNS_PER_TABLE = 64
PREVIEW_TABLES = 5
PREVIEW_COLUMNS = 6

CATALOG_SCHEMA = "schema string, table string, ordinal int, column string, type string, logical_type string"


def catalog_columns(tables: Mapping[str, DataFrame], schema: str = "main") -> DataFrame:
    """Catalog rows of loaded tables."""
    rows = [
        (schema, name, i, f.name, f.dataType.simpleString(), logical_type(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return session.literal_rows(spark, rows, CATALOG_SCHEMA)


def clean_grants(names: Sequence[str] | None) -> list[str]:
    """Schema names, trimmed, distinct without regard to case, first spelling kept."""
    kept: dict[str, str] = {}
    for raw in names or []:
        name = str(raw or "").strip()
        if name:
            kept.setdefault(name.lower(), name)
    return list(kept.values())


def granted(catalog: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Catalog rows of the allowed schemas."""
    allowed = [(s.lower(),) for s in clean_grants(schemas)]
    grants = session.literal_rows(catalog.sparkSession, allowed, "__schema string")
    return catalog.join(grants, F.lower("schema") == F.col("__schema"), "left_semi")


def inventory(
    catalog: DataFrame,
    max_tables: int = MAX_TABLES_PER_SCHEMA,
    max_columns: int = MAX_COLUMNS_PER_TABLE,
) -> DataFrame:
    """(schema, table, columns, column_count, table_count): the first tables of each schema by name.

    ``column_count`` and ``table_count`` count before the cuts, so a reader sees what is left out.
    """
    tables = catalog.groupBy("schema", "table").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.sort_array(F.collect_list(F.struct("ordinal", "column"))).alias("ordered"),
    )
    rank = F.row_number().over(Window.partitionBy("schema").orderBy("table"))
    totals = catalog.groupBy("schema").agg(F.count_distinct("table").alias("table_count"))
    capped = tables.withColumn("rank", rank).where(F.col("rank") <= max_tables).join(totals, "schema")
    names = F.slice(F.transform("ordered", lambda c: c["column"]), 1, max_columns)
    return capped.select("schema", "table", names.alias("columns"), "column_count", "table_count")


def inventory_preview(catalog: DataFrame) -> DataFrame:
    """(schema, table_count, tables): a short look at each schema's inventory; all its tables are counted."""
    listed = inventory(catalog)
    rank = F.row_number().over(Window.partitionBy("schema").orderBy("table"))
    first = listed.withColumn("rank", rank)
    shown = F.when(
        F.col("rank") <= PREVIEW_TABLES,
        F.struct("rank", "table", F.slice("columns", 1, PREVIEW_COLUMNS).alias("columns")),
    )
    # An inventory has at most 25 tables per schema.
    return first.groupBy("schema").agg(
        F.max("table_count").alias("table_count"),
        F.transform(
            F.sort_array(F.collect_list(shown)),
            lambda t: F.struct(t["table"].alias("table"), t["columns"].alias("columns")),
        ).alias("tables"),
    )


def feed_columns(profiles: DataFrame, exclude: str | None = None) -> DataFrame:
    """(feed, column, dtype) of the latest version of every other feed.

    ``profiles`` holds one row per feed, version and column.
    """
    others = profiles if exclude is None else profiles.where(F.col("feed") != exclude)
    newest = others.groupBy("feed").agg(F.max("version").alias("version"))
    return others.join(newest, ["feed", "version"]).select("feed", "column", "dtype")


def latest_feeds(feeds: DataFrame, versions: DataFrame) -> DataFrame:
    """Each feed with its newest version, feeds without one included."""
    newest = last_per_group(versions, ["feed"], ["version"])
    return feeds.join(newest, "feed", "left")
