"""Differences between two versions of a feed, from their column profiles.

A profile has one row per column, so everything here is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

NULL_POINTS = 5.0


def _described(profile: DataFrame, side: str) -> DataFrame:
    return profile.select(
        "column",
        F.col("dtype").alias(f"{side}_dtype"),
        F.col("null_percent").alias(f"{side}_null"),
        F.col("rows").alias(f"{side}_rows"),
    )


def column_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change, previous, current, delta), one row per difference.

    Changes: ``added``, ``removed``, ``type``, and ``null_ratio`` when the share
    of missing values moved by five points or more.
    """
    both = _described(previous, "old").join(_described(current, "new"), "column", "full")
    delta = F.col("new_null") - F.col("old_null")
    known = F.col("old_dtype").isNotNull() & F.col("new_dtype").isNotNull()

    def change(test: Column, kind: str, before: Column, after: Column, move: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("change"),
                before.cast("string").alias("previous"),
                after.cast("string").alias("current"),
                move.cast("double").alias("delta"),
            ),
        )

    nothing = F.lit(None)
    old_type, new_type = F.col("old_dtype"), F.col("new_dtype")
    changes = F.array_compact(
        F.array(
            change(old_type.isNull(), "added", nothing, new_type, nothing),
            change(new_type.isNull(), "removed", old_type, nothing, nothing),
            change(known & (old_type != new_type), "type", old_type, new_type, nothing),
            change(
                known & (F.abs(delta) >= NULL_POINTS),
                "null_ratio",
                F.round("old_null", 3),
                F.round("new_null", 3),
                F.round(delta, 3),
            ),
        )
    )
    return both.select("column", F.explode(changes).alias("c")).select("column", "c.*")


def drift_summary(previous: DataFrame | None, current: DataFrame) -> DataFrame:
    """One row: status, previous and current rows, row delta, counts per change.

    Without a previous version the status is ``baseline``.
    """
    if previous is None:
        now = current.agg(F.max("rows").alias("current_rows"))
        none = F.lit(None).cast("bigint")
        return now.select(
            F.lit("baseline").alias("status"),
            none.alias("previous_rows"),
            "current_rows",
            none.alias("row_delta"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("added", "removed", "type", "null_ratio")],
        )
    rows = previous.select(F.col("rows").alias("old_rows"), F.lit(None).cast("bigint").alias("new_rows"))
    rows = rows.unionByName(
        current.select(F.lit(None).cast("bigint").alias("old_rows"), F.col("rows").alias("new_rows"))
    ).withColumn("change", F.lit(None).cast("string"))
    none = F.lit(None).cast("bigint")
    moves = column_drift(previous, current).select(
        none.alias("old_rows"), none.alias("new_rows"), "change"
    )
    counts = {
        c: F.count_if(F.col("change") == c) for c in ("added", "removed", "type", "null_ratio")
    }
    summed = rows.unionByName(moves).agg(
        F.coalesce(F.max("old_rows"), F.lit(0)).alias("previous_rows"),
        F.coalesce(F.max("new_rows"), F.lit(0)).alias("seen_rows"),
        *[expr.alias(c) for c, expr in counts.items()],
    )
    current_rows = F.when(F.col("seen_rows") == 0, F.col("previous_rows")).otherwise(F.col("seen_rows"))
    row_delta = current_rows - F.col("previous_rows")
    changed = (F.col("added") + F.col("removed") + F.col("type") + F.col("null_ratio") > 0) | (
        row_delta != 0
    )
    return summed.select(
        F.when(changed, "changed").otherwise("no_change").alias("status"),
        "previous_rows",
        current_rows.alias("current_rows"),
        row_delta.alias("row_delta"),
        *counts,
    )


def row_deltas(versions: DataFrame) -> DataFrame:
    """(feed, version, current, previous, delta, has_prior) over a version table."""
    order = Window.partitionBy("feed").orderBy("version")
    previous = F.lag("row_count").over(order)
    return versions.select(
        "feed",
        "version",
        F.col("row_count").alias("current_rows"),
        previous.alias("previous_rows"),
        (F.col("row_count") - previous).alias("row_delta"),
        previous.isNotNull().alias("has_prior"),
    )


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, side) for two catalogs' columns: ``both``, ``left`` or ``right``."""
    a = left.select("column").distinct().withColumn("in_left", F.lit(True))
    b = right.select("column").distinct().withColumn("in_right", F.lit(True))
    side = (
        F.when(F.col("in_left") & F.col("in_right"), "both")
        .when(F.col("in_left"), "left")
        .otherwise("right")
    )
    return a.join(b, "column", "full").select("column", side.alias("side"))
