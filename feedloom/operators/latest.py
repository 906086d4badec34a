"""Latest-per-group reads and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.types import col


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group; Spark trims each task to one row per key before the shuffle."""
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def _columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [col(c) if isinstance(c, str) else c for c in order_by]


def first_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    return _first(df, keys, _columns(order_by))


def last_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    return _first(df, keys, [c.desc() for c in _columns(order_by)])


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once.

    Keys are counted by hash with map-side combining, without the rows, and the lone keys are
    joined back, so no group is gathered and no row is sorted for the count.
    """
    marks = [f"__k{i}" for i in range(len(keys))]
    grouped = df.groupBy(*[col(k).alias(m) for k, m in zip(keys, marks)]).agg(F.count(F.lit(1)).alias("__n"))
    lone = grouped.where(F.col("__n") == 1).drop("__n")
    same = reduce(lambda p, q: p & q, [df[f"`{k.replace('`', '``')}`"].eqNullSafe(lone[m]) for k, m in zip(keys, marks)])
    return df.join(lone, same, "left_semi")


def deduplicate(
    df: DataFrame,
    subset: Sequence[str],
    keep: str = "first",
    order_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per key (first, last), or only rows whose key is unique (any).

    Rows of a table have no order of their own: ``order_by`` says what first
    and last mean. Without it all columns are taken in order. NULL keys are equal.
    """
    if not subset:
        raise ValueError("deduplicate needs at least one column")
    if keep == "any":
        return unique_rows(df, subset)
    order = order_by or [c for c in df.columns if c not in subset] or list(subset)
    if keep == "first":
        return first_per_group(df, subset, order)
    if keep == "last":
        return last_per_group(df, subset, order)
    raise ValueError(f"keep must be first, last or any, not {keep!r}")


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.where(F.col("occurrences") > 1)


def latest_version(df: DataFrame, key: str, version: str = "version", wanted: int | None = None) -> DataFrame:
    """The newest version per key, or the wanted one."""
    if wanted is not None:
        df = df.where(col(version) == wanted)
    return last_per_group(df, [key], [version])


def recent_distinct(
    log: DataFrame, user: str, item: str, at: str, keep: int = 50, read: int = 10
) -> DataFrame:
    """Per user the most recent distinct items, newest first.

    Repeats move to the front. The log is first reduced to one row per user and
    item, so frequent repeats cost nothing.
    """
    latest = log.groupBy(col(user), col(item)).agg(F.max(col(at)).alias("last_asked"))
    window = Window.partitionBy(user).orderBy(F.desc("last_asked"), F.asc(item))
    ranked = latest.withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= min(keep, read))
