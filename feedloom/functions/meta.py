"""Tags, metadata JSON, JSON-safe rows and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.numbers import iso
from feedloom.types import as_text, col, logical_type, missing

METADATA_SCHEMA = (
    "source string, row_index int, type string, id string, user_id string, "
    "tags array<string>, column_name string, dtype string"
)


def split_tags(text: Column) -> Column:
    """Comma list to array, blanks trimmed, empty entries dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ",")


def read_metadata(json_text: Column) -> Column:
    """Metadata struct with the defaults a chunk has when fields are absent.

    A stored row index of 0 stays 0.
    """
    raw = F.from_json(json_text, METADATA_SCHEMA)
    return F.struct(
        F.coalesce(raw["source"], F.lit("")).alias("source"),
        F.coalesce(raw["row_index"], F.lit(-1)).alias("row_index"),
        F.coalesce(raw["type"], F.lit("excel")).alias("type"),
        raw["id"].alias("id"),
        F.coalesce(raw["user_id"], F.lit("default")).alias("user_id"),
        F.coalesce(raw["tags"], F.array().cast("array<string>")).alias("tags"),
        raw["column_name"].alias("column_name"),
        raw["dtype"].alias("dtype"),
    )


def write_metadata(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def json_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One JSON object per row: NaN as null, timestamps in ISO form, bytes as text."""
    safe = []
    for name in columns or df.columns:
        f = df.schema[name]
        kind = logical_type(f.dataType)
        if kind == "float":
            value = F.when(missing(f), F.lit(None)).otherwise(col(name))
        elif kind == "binary":
            value = F.decode(col(name), "UTF-8")
        elif kind == "interval" or isinstance(f.dataType, T.DateType):
            value = col(name).cast("string")
        elif kind == "datetime":
            value = iso(col(name))
        else:
            value = col(name)
        safe.append(value.alias(name))
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})


def sha1_prefix(c: Column, chars: int = 16) -> Column:
    return F.substring(F.sha1(c), 1, chars)


def sha256_prefix(c: Column, chars: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)


def row_hash(schema: T.StructType) -> Column:
    """64-bit hash of a whole row; NULL differs from empty, NaN counts as NULL."""
    parts = []
    for f in schema.fields:
        kind = logical_type(f.dataType)
        value = as_text(f) if kind in ("nested", "interval") else col(f.name)
        if kind == "float":
            value = F.when(missing(f), F.lit(None)).otherwise(value)
        parts += [value, missing(f)]
    return F.xxhash64(*parts)
