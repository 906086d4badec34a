"""Analysis plans: metric tasks derived from a schema and run on the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.drift import column_drift, drift_summary
from feedloom.operators.profile import (
    correlation_pairs,
    date_ranges,
    leaderboard_pairs,
    leaderboards,
    light_profile,
    null_audit,
    top_values,
)
from feedloom.sources.catalog import inventory
from feedloom.types import is_numeric, logical_type

RESULT_COLUMNS = ("task", "type", "subject", "label", "value", "note")
MAX_TASKS = 12
TOP_N = 10


@dataclass(frozen=True)
class Task:
    type: str
    column: str | None = None
    group: str | None = None
    value: str | None = None
    schema: str | None = None
    n: int = TOP_N


def derive_plan(
    df: DataFrame, limit: int = MAX_TASKS, *, has_prior: bool = False, schemas: Sequence[str] = ()
) -> list[Task]:
    """Counts per text column, leaderboards, and structural tasks, ``limit`` at most.

    Structural tasks and one leaderboard keep their slots; what is cut first are counts of further
    columns. :func:`left_out` lists what the limit cuts.
    """
    return _ordered(df, limit, has_prior, schemas)[0]


def left_out(
    df: DataFrame, limit: int = MAX_TASKS, *, has_prior: bool = False, schemas: Sequence[str] = ()
) -> list[Task]:
    """The tasks that :func:`derive_plan` cuts for its limit."""
    return _ordered(df, limit, has_prior, schemas)[1]


def _ordered(df: DataFrame, limit: int, has_prior: bool, schemas: Sequence[str]) -> tuple[list[Task], list[Task]]:
    texts = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    counts = [Task("count_by", column=c) for c in texts]
    boards = [Task("avg_by", group=g, value=v) for g, v in leaderboard_pairs(df)]
    extra = [Task("null_audit")]
    if has_prior:
        extra += [Task("drift_check"), Task("row_delta")]
    if any(logical_type(f.dataType) == "datetime" for f in df.schema.fields):
        extra.append(Task("date_range"))
    inventories = [Task("schema_inventory", schema=s) for s in schemas]
    fixed = extra + inventories[:1]
    kept = counts[: max(limit - len(fixed) - len(boards[:1]), min(limit, 2))]
    kept = kept + boards[: max(limit - len(kept) - len(fixed), 0)]
    counted = {t.column for t in kept if t.type == "count_by"}
    strings = [f.name for f in df.schema.fields if logical_type(f.dataType) == "string"]
    tops = [Task("top_n", column=c) for c in strings if c not in counted][:1]
    spare = tops[: max(limit - len(kept) - len(fixed), 0)]
    plan = (kept + extra + spare + inventories)[:limit]
    return plan, [t for t in counts + boards + extra + tops + inventories if t not in plan]


def _rows(df: DataFrame, task: Column, kind: str | Column, **columns: Column) -> DataFrame:
    def take(name: str, dtype: str) -> Column:
        return columns.get(name, F.lit(None)).cast(dtype).alias(name)

    return df.select(
        task.cast("int").alias("task"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        take("subject", "string"),
        take("label", "string"),
        take("value", "double"),
        take("note", "string"),
    )


def _number_of(subject: Column, numbers: list[tuple[int, str]]) -> Column:
    """Task numbers by subject; a subject asked for twice has several."""
    by_subject: dict[str, list[int]] = {}
    for i, name in numbers:
        by_subject.setdefault(name, []).append(i)
    entries = [x for name, ids in by_subject.items() for x in (F.lit(name), F.array(*map(F.lit, ids)))]
    return F.explode(F.element_at(F.create_map(*entries), subject))


def run_plan(
    df: DataFrame,
    tasks: Sequence[Task],
    *,
    previous: DataFrame | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """(task, type, subject, label, value, note); tasks of one kind share an aggregate."""
    spark, parts = df.sparkSession, []
    by_kind: dict[str, list[tuple[int, Task]]] = {}
    for i, task in enumerate(tasks):
        by_kind.setdefault(task.type, []).append((i, task))

    for kind, default_k in (("count_by", 5), ("top_n", None)):
        for k in sorted({default_k or t.n for _, t in by_kind.get(kind, [])}):
            chosen = [(i, t.column) for i, t in by_kind[kind] if (default_k or t.n) == k]
            ranked = top_values(df, list(dict.fromkeys(c for _, c in chosen)), k)
            joined = ranked.withColumn("task", _number_of(F.col("column"), chosen))
            parts.append(
                _rows(
                    joined, F.col("task"), kind, subject=F.col("column"), label=F.col("label"),
                    value=F.col("count"), note=F.col("rank"),
                )
            )
    if "avg_by" in by_kind:
        chosen = [(i, t.group, t.value) for i, t in by_kind["avg_by"]]
        pairs = list(dict.fromkeys((g, v) for _, g, v in chosen))
        number = _number_of(F.concat_ws("\n", "group", "value"), [(i, f"{g}\n{v}") for i, g, v in chosen])
        boards = leaderboards(df, pairs).withColumn("task", number)
        parts.append(
            _rows(
                boards, F.col("task"), "avg_by", subject=F.concat_ws(" by ", "value", "group"),
                label=F.col("label"), value=F.col("mean"), note=F.concat_ws(" ", "side", "rank"),
            )
        )
    for i, task in by_kind.get("null_audit", []):
        columns = [task.column] if task.column else None
        parts.append(
            _rows(
                null_audit(df, columns), F.lit(i), "null_audit", subject=F.col("column"),
                label=F.lit("null_percent"), value=F.col("null_percent"),
            )
        )
    for i, task in by_kind.get("date_range", []):
        ranges = date_ranges(df, [task.column] if task.column else None)
        for edge in ("min", "max"):
            parts.append(
                _rows(ranges, F.lit(i), "date_range", subject=F.col("column"), label=F.lit(edge), note=F.col(edge))
            )
    for i, task in by_kind.get("correlation_hint", []):
        strong = correlation_pairs(df).where("strong")
        parts.append(
            _rows(
                strong, F.lit(i), "correlation_hint", subject=F.col("col_a"), label=F.col("col_b"),
                value=F.col("correlation"),
            )
        )
    if by_kind.get("drift_check") or by_kind.get("row_delta"):
        parts += _drift_rows(df, previous, by_kind)
    for i, task in by_kind.get("schema_inventory", []):
        if catalog is None:
            raise ValueError("schema_inventory needs a catalog")
        listed = inventory(catalog.where(F.col("schema") == task.schema))
        parts.append(
            _rows(
                listed, F.lit(i), "schema_inventory", subject=F.col("schema"), label=F.col("table"),
                value=F.col("column_count"), note=F.array_join(F.slice("columns", 1, 6), ", "),
            )
        )
    unknown = sorted(set(by_kind) - set(KINDS))
    if unknown:
        raise ValueError(f"unknown task types {unknown}")
    if not parts:
        return spark.createDataFrame(
            [], "task int, type string, subject string, label string, value double, note string"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


KINDS = (
    "count_by", "avg_by", "null_audit", "drift_check", "row_delta", "date_range", "top_n",
    "correlation_hint", "schema_inventory",
)


def _drift_rows(df: DataFrame, previous: DataFrame | None, by_kind: dict) -> list[DataFrame]:
    """Drift needs dtypes and null shares only, so no distinct values are counted."""

    now = light_profile(df)
    before = None if previous is None else light_profile(previous)
    parts = []
    for i, _ in by_kind.get("drift_check", []):
        if before is None:
            parts.append(_rows(drift_summary(None, now), F.lit(i), "drift_check", label=F.col("status")))
            continue
        moves = column_drift(before, now)
        parts.append(
            _rows(
                moves, F.lit(i), "drift_check", subject=F.col("column"), label=F.col("change"),
                value=F.col("delta"), note=F.concat_ws(" -> ", "previous", "current"),
            )
        )
    for i, _ in by_kind.get("row_delta", []):
        summary = drift_summary(before, now)
        for label in ("previous_rows", "current_rows", "row_delta"):
            parts.append(
                _rows(summary, F.lit(i), "row_delta", label=F.lit(label), value=F.col(label), note=F.col("status"))
            )
    return parts


