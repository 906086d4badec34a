"""Equi joins with the table semantics users of data frames expect.

Missing keys match each other unless told otherwise, a key that has the same
name on both sides appears once, and only overlapping other names get a suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.types import col

KINDS = ("left", "inner", "right", "outer")


def _prepared(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    suffixes: tuple[str, str],
    select: Sequence[str] | None,
) -> tuple[DataFrame, DataFrame, list[tuple[str, str]], list[str]]:
    """Renamed sides, the key pairs after renaming, and the output columns."""
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("left_on and right_on need the same number of columns")
    if select is not None:
        lost = [k for k in right_on if k not in select]
        if lost:
            raise ValueError(f"select must include the join keys; missing {lost}")
        right = right.select(*[col(c) for c in select])
    for side, keys, frame in (("left", left_on, left), ("right", right_on, right)):
        unknown = [k for k in keys if k not in frame.columns]
        if unknown:
            raise ValueError(f"{side} key columns not found: {unknown}")
    shared_keys = [a for a, b in zip(left_on, right_on) if a == b]
    overlap = set(left.columns) & set(right.columns) - set(shared_keys)
    if overlap and suffixes[0] == suffixes[1]:
        raise ValueError(f"columns overlap but suffixes are equal: {sorted(overlap)}")
    left_names = [c + suffixes[0] if c in overlap else c for c in left.columns]
    right_names = [c + suffixes[1] if c in overlap else c for c in right.columns]
    hidden = {c: f"__right_{c}" for c in shared_keys}
    left_out = left.toDF(*left_names)
    right_out = right.toDF(*[hidden.get(c, c) for c in right_names])
    left_new, right_new = dict(zip(left.columns, left_names)), dict(zip(right.columns, right_names))
    pairs = [
        (left_new[a], hidden[b] if a == b else right_new[b]) for a, b in zip(left_on, right_on)
    ]
    output = left_names + [c for c in right_names if c not in hidden]
    clash = [c for c in output if output.count(c) > 1]
    if clash:
        raise ValueError(f"suffixes make duplicate column names: {sorted(set(clash))}")
    return left_out, right_out, pairs, output


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "left",
    *,
    suffixes: tuple[str, str] = ("", "_right"),
    select: Sequence[str] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Join two tables on key columns matched by position.

    Spark chooses broadcast or sort-merge from measured sizes and splits hot
    keys of inner, left and right joins at run time. A full outer join cannot
    be split that way, so it is built from a left join and an anti join, both
    of which can.
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    lhs, rhs, pairs, output = _prepared(
        left, right, list(left_on), list(right_on or left_on), tuple(suffixes), select
    )

    def condition(a: DataFrame, b: DataFrame):
        tests = [
            a[f"`{x}`"].eqNullSafe(b[f"`{y}`"]) if null_safe else a[f"`{x}`"] == b[f"`{y}`"]
            for x, y in pairs
        ]
        return reduce(lambda p, q: p & q, tests)

    kind = "left" if how == "outer" else how
    joined = lhs.join(rhs, condition(lhs, rhs), kind)
    shared = {x: y for x, y in pairs if y == f"__right_{x}"}
    pick = []
    for name in output:
        if name in shared and how == "right":
            pick.append(col(shared[name]).alias(name))
        else:
            pick.append(col(name))
    result = joined.select(*pick)
    if how != "outer":
        return result
    # Right rows without a partner. The keys of the left side are reduced to
    # distinct ones first, so a hot left key is a single row here.
    keys = lhs.select(*[col(x).alias(f"__k{i}") for i, (x, _) in enumerate(pairs)]).distinct()
    tests = [
        keys[f"__k{i}"].eqNullSafe(rhs[f"`{y}`"]) if null_safe else keys[f"__k{i}"] == rhs[f"`{y}`"]
        for i, (_, y) in enumerate(pairs)
    ]
    alone = rhs.join(keys, reduce(lambda p, q: p & q, tests), "left_anti")
    right_columns = set(rhs.columns)
    fill = []
    for name in output:
        source = shared.get(name, name)
        if source in right_columns:
            fill.append(col(source).alias(name))
        else:
            fill.append(F.lit(None).cast(result.schema[name].dataType).alias(name))
    return result.unionByName(alone.select(*fill))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Sequence | None = None) -> DataFrame:
    """Old rows whose key is absent from the new ones, plus the new rows.

    With ``order_by`` the last new row per key wins; without it the new rows
    are taken as unique per key.
    """
    from feedloom.operators.latest import last_per_group

    if order_by is not None:
        new = last_per_group(new, keys, order_by)
    marks = new.select(*[col(k).alias(f"__n{i}") for i, k in enumerate(keys)])
    tests = [old[f"`{k}`"].eqNullSafe(marks[f"__n{i}"]) for i, k in enumerate(keys)]
    kept = old.join(marks, reduce(lambda p, q: p & q, tests), "left_anti")
    return kept.unionByName(new)
