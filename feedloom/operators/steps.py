"""Declarative cleaning steps; each is one lazy ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import MISSING, dataclass, fields
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from feedloom.functions.meta import json_row
from feedloom.functions.text import collapse_whitespace, strip
from feedloom.operators.joins import join_tables
from feedloom.operators.latest import deduplicate
from feedloom.operators.predicates import Condition
from feedloom.session import literal_rows
from feedloom.types import as_text, col, field, logical_type, missing, spark_dtype

Context = Mapping[str, DataFrame]


class Step:
    """A step reads its parameters from its fields and changes a frame."""

    type: ClassVar[str]

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Rename(Step):
    """One column, or several by ``mapping``; absent columns are left alone."""

    type: ClassVar[str] = "rename"
    column: str | None = None
    new_name: str | None = None
    mapping: Mapping[str, str] | None = None

    def __post_init__(self):
        if (self.column is None) != (self.new_name is None) or not (self.column or self.mapping):
            raise ValueError("rename needs column and new_name, or mapping")

    def apply(self, df, context):
        names = dict(self.mapping or {})
        if self.column is not None:
            names[self.column] = self.new_name
        return df.withColumnsRenamed(names)


@dataclass(frozen=True)
class Cast(Step):
    """Bad values fail the job, or become NULL with ``on_error='null'``."""

    type: ClassVar[str] = "cast"
    column: str
    dtype: str
    on_error: str = "raise"

    def apply(self, df, context):
        field(df, self.column)
        target, c = spark_dtype(self.dtype), col(self.column)
        cast = c.try_cast(target) if self.on_error == "null" else c.cast(target)
        return df.withColumn(self.column, cast)


@dataclass(frozen=True)
class Trim(Step):
    type: ClassVar[str] = "trim"
    column: str
    method: str = "both"

    def __post_init__(self):
        if self.method not in ("both", "left", "right"):
            raise ValueError("method must be both, left or right")

    def apply(self, df, context):
        field(df, self.column)
        return df.withColumn(self.column, strip(col(self.column).cast("string"), self.method))


# Strftime directives and their Spark pattern letters.
DATE_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%p": "a", "%%": "%",
}


def spark_date_pattern(pattern: str) -> str:
    """A strftime pattern as a Spark datetime pattern; others pass through."""
    if "%" not in pattern:
        return pattern
    out, i = [], 0
    while i < len(pattern):
        token = pattern[i : i + 2]
        if token in DATE_DIRECTIVES:
            out.append(DATE_DIRECTIVES[token])
            i += 2
        elif pattern[i] == "%":
            raise ValueError(f"unsupported date directive {token!r}")
        else:
            out.append("'" + pattern[i] + "'" if pattern[i].isalpha() else pattern[i])
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class ParseDate(Step):
    """``coerce`` turns bad dates into NULL, ``raise`` fails, ``ignore`` keeps the text."""

    type: ClassVar[str] = "parse_date"
    column: str
    format: str | None = None
    errors: str = "coerce"

    def __post_init__(self):
        if self.errors not in ("raise", "coerce", "ignore"):
            raise ValueError("errors must be raise, coerce or ignore")

    def apply(self, df, context):
        f, c = field(df, self.column), col(self.column)
        if logical_type(f.dataType) == "datetime":
            return df
        text = c.cast("string")
        pattern = [] if self.format is None else [F.lit(spark_date_pattern(self.format))]
        if self.errors == "raise":
            return df.withColumn(self.column, F.to_timestamp_ntz(text, *pattern))
        # try_to_timestamp yields session-zone instants; the wall clock is kept.
        parsed = F.try_to_timestamp(text, *pattern).cast("timestamp_ntz")
        if self.errors == "ignore":
            shown = F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")
            parsed = F.coalesce(shown, text)
        return df.withColumn(self.column, parsed)


@dataclass(frozen=True)
class FillNA(Step):
    type: ClassVar[str] = "fillna"
    column: str
    value: object

    def apply(self, df, context):
        f = field(df, self.column)
        value = F.lit(self.value).cast(f.dataType)
        return df.withColumn(self.column, F.when(missing(f), value).otherwise(col(self.column)))


#: A mapping with more entries than this is joined instead of inlined.
INLINE_MAPPING = 200


@dataclass(frozen=True)
class MapValues(Step):
    """Replace values; unmapped ones get ``default`` or stay as they are."""

    type: ClassVar[str] = "map_values"
    column: str
    mapping: Mapping[str, object]
    default: object = None

    def apply(self, df, context):
        f = field(df, self.column)
        c, key = col(self.column), as_text(f)
        values = {str(k): None if v is None else str(v) for k, v in self.mapping.items()}
        other = c.cast("string") if self.default is None else F.lit(str(self.default))
        if len(values) <= INLINE_MAPPING:
            pairs = [F.lit(x) for kv in values.items() for x in kv]
            found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
            mapped = F.coalesce(found.cast("string"), other)
            return df.withColumn(self.column, self._typed(f, mapped))
        table = literal_rows(df.sparkSession, list(values.items()), "__from string, __to string")
        joined = df.withColumn("__key", key).join(table, F.col("__key") == F.col("__from"), "left")
        mapped = F.coalesce("__to", other)
        return joined.withColumn(self.column, self._typed(f, mapped)).select(
            *[col(name) for name in df.columns]
        )

    def _typed(self, f, mapped: Column) -> Column:
        """Text columns stay text; others keep their type when every value allows it."""
        if logical_type(f.dataType) == "string":
            return mapped
        results = [v for v in self.mapping.values() if v is not None]
        results += [] if self.default is None else [self.default]
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in results):
            whole = logical_type(f.dataType) == "integer" and all(isinstance(v, int) for v in results)
            return mapped.cast("bigint" if whole else "double")
        return mapped


@dataclass(frozen=True)
class SplitColumn(Step):
    """Split on a literal delimiter; surplus parts are dropped, absent ones NULL."""

    type: ClassVar[str] = "split_column"
    column: str
    into: Sequence[str]
    delimiter: str
    drop_original: bool = False

    def __post_init__(self):
        if len(self.into) < 2:
            raise ValueError("split_column needs at least two target columns")

    def apply(self, df, context):
        text = as_text(field(df, self.column))
        literal = "\\Q" + self.delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        df = df.withColumn("__parts", F.split(text, literal))
        for i, name in enumerate(self.into):
            df = df.withColumn(name, F.get("__parts", F.lit(i)))
        drop = ["__parts"]
        if self.drop_original and self.column not in self.into:
            drop.append(self.column)
        return df.drop(*drop)


@dataclass(frozen=True)
class MergeColumns(Step):
    """Join columns into one text; a missing value counts as empty text."""

    type: ClassVar[str] = "merge_columns"
    columns: Sequence[str]
    into: str
    separator: str = " "
    drop_sources: bool = False

    def __post_init__(self):
        if len(self.columns) < 2:
            raise ValueError("merge_columns needs at least two source columns")

    def apply(self, df, context):
        parts = [F.coalesce(as_text(field(df, c)), F.lit("")) for c in self.columns]
        df = df.withColumn(self.into, F.concat_ws(self.separator, *parts))
        if self.drop_sources:
            df = df.drop(*[c for c in self.columns if c != self.into])
        return df


@dataclass(frozen=True)
class Deduplicate(Step):
    type: ClassVar[str] = "deduplicate"
    subset: Sequence[str]
    keep: str = "first"
    order_by: Sequence[str] | None = None

    def __post_init__(self):
        if not self.subset:
            raise ValueError("deduplicate needs at least one column")

    def apply(self, df, context):
        return deduplicate(df, self.subset, self.keep, self.order_by)


@dataclass(frozen=True)
class Join(Step):
    type: ClassVar[str] = "join"
    right_dataset: str
    left_on: Sequence[str]
    right_on: Sequence[str]
    how: str = "left"
    suffixes: Sequence[str] = ("", "_right")
    select: Sequence[str] | None = None
    null_safe: bool = True

    def __post_init__(self):
        if not self.left_on or not self.right_on:
            raise ValueError("join keys cannot be empty")
        if len(self.suffixes) != 2:
            raise ValueError("suffixes needs exactly two values")

    def apply(self, df, context):
        if self.right_dataset not in context:
            raise ValueError(f"join dataset {self.right_dataset!r} is not in the context")
        return join_tables(
            df, context[self.right_dataset], self.left_on, self.right_on, self.how,
            suffixes=tuple(self.suffixes), select=self.select, null_safe=self.null_safe,
        )


@dataclass(frozen=True)
class Filter(Step):
    type: ClassVar[str] = "filter"
    column: str
    op: str
    value: object
    negate: bool = False

    def apply(self, df, context):
        test = Condition(self.column, self.op, self.value).on(df)
        return df.where(~F.coalesce(test, F.lit(False)) if self.negate else test)


@dataclass(frozen=True)
class Select(Step):
    type: ClassVar[str] = "select"
    columns: Sequence[str]

    def apply(self, df, context):
        return df.select(*[col(field(df, c).name) for c in self.columns])


@dataclass(frozen=True)
class Drop(Step):
    type: ClassVar[str] = "drop"
    columns: Sequence[str]

    def apply(self, df, context):
        return df.drop(*self.columns)


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": F.initcap,
    "collapse": collapse_whitespace,
}


@dataclass(frozen=True)
class StringClean(Step):
    type: ClassVar[str] = "string_clean"
    columns: Sequence[str]
    operations: Sequence[str]

    def __post_init__(self):
        unknown = [o for o in self.operations if o not in CLEANERS]
        if unknown:
            raise ValueError(f"unknown operations {unknown}; have {sorted(CLEANERS)}")

    def apply(self, df, context):
        cleaned = {}
        for name in self.columns:
            c = col(field(df, name).name).cast("string")
            for operation in self.operations:
                c = CLEANERS[operation](c)
            cleaned[name] = c
        return df.withColumns(cleaned)


@dataclass(frozen=True)
class Custom(Step):
    """Any function from frame to frame."""

    type: ClassVar[str] = "custom"
    function: Callable[[DataFrame], DataFrame]

    def apply(self, df, context):
        return self.function(df)


STEP_TYPES: dict[str, type[Step]] = {
    cls.type: cls
    for cls in (
        Rename, Cast, Trim, ParseDate, FillNA, MapValues, SplitColumn, MergeColumns,
        Deduplicate, Join, Filter, Select, Drop, StringClean, Custom,
    )
}


def step_from(definition: Mapping[str, object]) -> Step:
    """A step from its JSON form; unknown types and fields are errors."""
    rest = dict(definition)
    cls = STEP_TYPES.get(str(rest.pop("type", None)))
    if cls is None:
        raise ValueError(f"unknown step type {definition.get('type')!r}")
    known = {f.name for f in fields(cls)}
    if set(rest) - known:
        raise ValueError(f"unknown fields for {cls.type}: {sorted(set(rest) - known)}")
    needed = {f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING}
    if needed - set(rest):
        raise ValueError(f"missing fields for {cls.type}: {sorted(needed - set(rest))}")
    return cls(**rest)


@dataclass(frozen=True)
class TransformDefinition:
    name: str
    feed_identifier: str
    target_table: str
    steps: Sequence[Step]
    description: str | None = None
    load_strategy: str = "append"
    unique_key: Sequence[str] | None = None
    incremental: bool = False

    @classmethod
    def from_dict(cls, definition: Mapping[str, object]) -> TransformDefinition:
        known = {f.name for f in fields(cls)}
        if set(definition) - known:
            raise ValueError(f"unknown fields: {sorted(set(definition) - known)}")
        values = dict(definition)
        values["steps"] = [
            s if isinstance(s, Step) else step_from(s) for s in definition.get("steps", [])
        ]
        return cls(**values)


def run_steps(df: DataFrame, steps: Sequence[Step | Mapping], context: Context | None = None) -> DataFrame:
    """Apply the steps in order; the result is one lazy plan."""
    built = [s if isinstance(s, Step) else step_from(s) for s in steps]
    return reduce(lambda frame, step: step.apply(frame, context or {}), built, df)


PREVIEW_ROWS = 5


def frame_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: row counts, columns added and removed, type changes, previews."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    changed = [
        f"{c}: {old[c]} -> {new[c]}" for c in sorted(set(old) & set(new)) if old[c] != new[c]
    ]
    sides = _measure(before, "before").unionAll(_measure(after, "after"))

    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    def listing(names: list[str]) -> Column:
        empty = F.array().cast("array<string>")
        return F.array(*[F.lit(n) for n in names]) if names else empty

    measured = sides.agg(
        of("before", "rows").alias("rows_before"),
        of("after", "rows").alias("rows_after"),
        of("before", "preview").alias("preview_before"),
        of("after", "preview").alias("preview_after"),
    )
    return measured.select(
        "rows_before",
        "rows_after",
        (F.col("rows_after") - F.col("rows_before")).alias("row_delta"),
        listing(sorted(set(new) - set(old))).alias("columns_added"),
        listing(sorted(set(old) - set(new))).alias("columns_removed"),
        listing(changed).alias("type_changes"),
        "preview_before",
        "preview_after",
    )


def _measure(df: DataFrame, side: str) -> DataFrame:
    """Row count and JSON preview of one side, as two rows."""
    no_rows, no_preview = F.lit(None).cast("bigint"), F.lit(None).cast("array<string>")
    counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("preview", no_preview)
    head = df.limit(PREVIEW_ROWS).select(json_row(df).alias("row"))
    shown = head.agg(F.collect_list("row").alias("preview")).select(no_rows.alias("rows"), "preview")
    return counted.unionByName(shown).withColumn("side", F.lit(side))


def dry_run(
    df: DataFrame,
    steps: Sequence[Step | Mapping],
    context: Context | None = None,
    rows: int = 500,
) -> DataFrame:
    """Run the steps on the first rows and compare before with after."""
    if rows < 1:
        raise ValueError("a dry run needs at least one row")
    head = df.limit(rows)
    return frame_diff(head, run_steps(head, steps, context))
