"""Row predicates: one condition per column, folded left to right."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.types import col, field, logical_type, missing

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains")


@dataclass(frozen=True)
class Condition:
    """``column op value``.

    Text compares without regard to case; ``contains`` is literal unless
    ``regex`` is set. Missing values fail every test except ``neq``.
    """

    column: str
    op: str
    value: object
    regex: bool = False

    def on(self, df: DataFrame) -> Column:
        if self.op not in OPS:
            raise ValueError(f"unsupported operator {self.op!r}")
        f = field(df, self.column)
        c, kind = col(self.column), logical_type(f.dataType)
        if self.op == "contains":
            return self._contains(c)
        if kind == "string":
            operand = F.lit(None if self.value is None else str(self.value))
            if self.op in ("eq", "neq"):
                c, operand = F.lower(c), F.lower(operand)
        else:
            operand = F.lit(self.value)
            if isinstance(self.value, str) or kind in ("datetime", "boolean"):
                operand = F.lit(str(self.value)).try_cast(f.dataType)
        if self.op == "neq":
            # A missing value differs from every operand, and so does an operand
            # that cannot be read as the column's type.
            return ~F.coalesce(c == operand, F.lit(False))
        tests = {
            "eq": lambda: c == operand,
            "gt": lambda: c > operand,
            "gte": lambda: c >= operand,
            "lt": lambda: c < operand,
            "lte": lambda: c <= operand,
        }
        test = tests[self.op]()
        # Spark orders NaN above every number; a missing value is not above anything.
        return test & ~missing(f) if kind == "float" and self.op in ("gt", "gte") else test

    def _contains(self, c: Column) -> Column:
        text, wanted = c.cast("string"), str(self.value)
        if self.regex:
            return F.coalesce(text.rlike(f"(?i){wanted}"), F.lit(False))
        return F.coalesce(F.lower(text).contains(wanted.lower()), F.lit(False))


def fold(df: DataFrame, conditions: Sequence[Condition], connectors: Sequence[str] = ()) -> Column:
    """Combine conditions strictly left to right; ``and`` and ``or`` bind alike."""
    if not conditions:
        raise ValueError("no conditions")
    links = list(connectors) + ["and"] * (len(conditions) - 1 - len(connectors))
    result = conditions[0].on(df)
    for link, condition in zip(links, conditions[1:]):
        test = condition.on(df)
        result = (result | test) if link == "or" else (result & test)
    return result


def keep_rows(df: DataFrame, conditions: Sequence[Condition], connectors: Sequence[str] = ()) -> DataFrame:
    return df.where(fold(df, conditions, connectors))


def rows_of_tenant(df: DataFrame, tenant: object, column: str = "user_id") -> DataFrame:
    """Rows of one tenant; prunes partitions when the table is partitioned by it."""
    return df.where(col(column) == F.lit(tenant))
