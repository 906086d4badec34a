"""Logical types, dtype aliases and the one definition of a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("integer", "float", "decimal", "boolean")

# Dtype names users write in cast steps.
DTYPE_ALIASES = {
    "int": "bigint",
    "int64": "bigint",
    "int32": "int",
    "int16": "smallint",
    "int8": "tinyint",
    "integer": "bigint",
    "float": "double",
    "float64": "double",
    "float32": "float",
    "number": "double",
    "str": "string",
    "object": "string",
    "string": "string",
    "category": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "datetime": "timestamp_ntz",
    "datetime64": "timestamp_ntz",
    "datetime64[ns]": "timestamp_ntz",
    "date": "date",
}


def logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.FractionalType):
        return "decimal" if isinstance(dtype, T.DecimalType) else "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "interval"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "string"


def is_numeric(dtype: T.DataType) -> bool:
    return logical_type(dtype) in NUMERIC


def spark_dtype(name: str) -> str:
    """Spark type name for a dtype alias; other names pass through."""
    return DTYPE_ALIASES.get(name.strip().lower(), name)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    try:
        return df.schema[name]
    except KeyError:
        raise ValueError(f"column {name!r} not found; have {df.columns}") from None


def missing(f: T.StructField) -> Column:
    """NULL, and NaN for floating types, is missing."""
    c = col(f.name)
    if logical_type(f.dataType) == "float":
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(f: T.StructField) -> Column:
    return ~missing(f)


def as_text(f: T.StructField) -> Column:
    """One string per distinct value of any type; missing stays NULL."""
    c = col(f.name)
    kind = logical_type(f.dataType)
    if kind == "float":
        zero_free = F.when(c == 0, F.lit(0.0)).otherwise(c)
        return F.when(missing(f), F.lit(None)).otherwise(zero_free.cast("string"))
    if kind == "binary":
        return F.base64(c)
    if kind == "nested":
        return F.to_json(c)
    return c.cast("string")


def as_number(f: T.StructField) -> Column:
    """Double value of a numeric or boolean column; missing stays NULL."""
    c = col(f.name)
    if logical_type(f.dataType) == "boolean":
        return c.cast("int").cast("double")
    number = c.cast("double")
    if logical_type(f.dataType) == "float":
        return F.when(missing(f), F.lit(None)).otherwise(number)
    return number
