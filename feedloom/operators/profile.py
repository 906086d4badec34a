"""Column profiling.

The exact profile counts every column's values in its own type, with map-side
combining, so a hot value is one pre-aggregated row per task and cannot skew
the shuffle. The frequency table is written to the shared folder once; counts,
distinct values, samples, top values, statistics and medians are all read from
it. The approximate profile is one aggregate without any shuffle of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import session
from feedloom.functions import names
from feedloom.functions.numbers import percent
from feedloom.types import as_number, as_text, col, field, is_numeric, logical_type, missing, present

NULL_LABEL = "∅"

PROFILE_SCHEMA = (
    "ordinal int, column string, dtype string, logical_type string, rows bigint, "
    "non_null bigint, nulls bigint, null_percent double, unique_count bigint, "
    "unique_percent double, is_key_candidate boolean, min double, max double, mean double, "
    "median double, sample_values array<string>, "
    "top_values array<struct<label:string,count:bigint>>"
)


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    return [field(df, name) for name in (columns or df.columns)]


def column_list(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The schema as rows (ordinal, column, dtype, logical_type)."""
    rows = [
        (i, f.name, f.dataType.simpleString(), logical_type(f.dataType))
        for i, f in enumerate(_fields(df, columns))
    ]
    schema = "ordinal int, column string, dtype string, logical_type string"
    return session.literal_rows(df.sparkSession, rows, schema)


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, value, number, n): how often each value of each column occurs.

    Each column is counted on its own, in its own type: the scan of a branch
    reads that column only, so together they read the table once. ``number`` is
    NULL for non-numeric columns.
    """
    return _readable(_counted(columnar(df, columns), _fields(df, columns), 0))


#: Plan nodes that let each column be scanned on its own.
_CHEAP_NODES = re.compile(r"^[\s:+-]*(Project|Filter|Relation .* (parquet|orc)$|LocalRelation)")


def columnar(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The frame as it is when its columns can be read one by one, else written once in columns.

    A scan of a row format, or a computed frame, would otherwise be repeated for every column.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    fields = _fields(df, columns)
    if len(fields) < 2 or all(_CHEAP_NODES.match(line) for line in plan):
        return df
    return session.materialize(df.select(*[col(f.name) for f in fields]), "columns")


def _counted(df: DataFrame, fields: Sequence[T.StructField], first: int) -> DataFrame:
    out = None
    for i, f in enumerate(fields):
        part = _counts_of(df, first + i, f)
        out = part if out is None else out.unionAll(part)
    return out


def _counts_of(df: DataFrame, ordinal: int, f: T.StructField) -> DataFrame:
    """(ordinal, text, whole, number, n): integers and doubles stay binary."""
    kind = logical_type(f.dataType)
    if kind == "float":
        cell = F.when(present(f), col(f.name))
    elif kind in ("binary", "nested", "interval"):
        cell = as_text(f)
    else:
        cell = col(f.name)
    counted = df.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    as_is = kind not in ("binary", "nested", "interval")
    grouped = T.StructField("cell", f.dataType if as_is else T.StringType())
    text, whole, number = (F.lit(None).cast(t) for t in ("string", "bigint", "double"))
    if kind == "integer":
        whole = F.col("cell").cast("bigint")
    elif is_numeric(f.dataType):
        number = as_number(grouped)
    if kind != "integer" and not isinstance(f.dataType, T.DoubleType):
        text = as_text(grouped)
    return counted.select(
        F.lit(ordinal).alias("ordinal"), text.alias("text"), whole.alias("whole"), number.alias("number"), "n"
    )


def _readable(counted: DataFrame) -> DataFrame:
    """Text and number of every value; computed only where a query uses them."""
    real = F.when(F.col("number") == 0, F.lit(0.0)).otherwise(F.col("number")).cast("string")
    return counted.select(
        "ordinal",
        F.coalesce("text", F.col("whole").cast("string"), real).alias("value"),
        F.coalesce("number", F.col("whole").cast("double")).alias("number"),
        "n",
    )


#: Columns counted per job, to keep plans of very wide tables small.
COLUMNS_PER_JOB = 48


def stored_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`value_frequencies`, written once to the shared folder."""
    fields, out = _fields(df, columns), None
    df = columnar(df, columns)
    for start in range(0, len(fields), COLUMNS_PER_JOB):
        block = _counted(df, fields[start : start + COLUMNS_PER_JOB], start)
        part = session.materialize(block, "frequencies")
        out = part if out is None else out.unionAll(part)
    return _readable(out)


def top_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The k first rows of each group.

    Spark keeps only k rows per group in every task before the shuffle
    (WindowGroupLimit), so a hot group never lands whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


#: Distinct values that one task of a median sorts, as long as the session's shuffles allow so many tasks.
MEDIAN_VALUES = 100_000


def exact_median(
    frequencies: DataFrame, key: str, number: str = "number", *, bound: int = MEDIAN_VALUES
) -> DataFrame:
    """(key, median) from a frequency table (key, number, n), a row per value or few; interpolated.

    The values of all keys are dealt to parts by range and stored. Totals of the parts, summed up in order,
    tell which part holds a wanted rank; only those parts are read again, and only there values are put in
    order. Any number of keys will do; a part has about ``bound`` values, with at most four times as many
    parts as the session's shuffles have tasks.
    """
    spark = frequencies.sparkSession
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = frequencies.where(F.col(number).isNotNull()).select(key, number, "n")
    parts = max(1, min(most, known.count() // bound + 1))
    ranged = known.repartitionByRange(parts, key, number).withColumn("part", F.spark_partition_id())
    stored = session.materialize(ranged, "ranged")
    by_part = stored.groupBy(key, "part").agg(F.sum("n").alias("weight"))
    own = Window.partitionBy(key)
    placed = by_part.select(
        key, "part", "weight", F.sum("weight").over(own).alias("total"),
        (F.sum("weight").over(own.orderBy("part")) - F.col("weight")).alias("before"),
    )
    # The middle value, or the two around the middle, by rank within their part.
    ranks = F.array_distinct(F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1))
    inside = F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("weight")))
    wanted = placed.select(key, "part", F.transform(inside, lambda r: r - F.col("before")).alias("ranks")).where(F.size("ranks") > 0)
    # By rows, not by value: large integers may share one double.
    upto = Window.partitionBy(key, "part").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("n").over(upto)
    reached = stored.join(wanted, [key, "part"]).withColumn("upto", running)
    hit = F.exists("ranks", lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))
    return reached.where(hit).groupBy(key).agg(((F.min(number) + F.max(number)) / 2).alias("median"))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the n smallest seeded row hashes."""
    from feedloom.functions.meta import row_hash

    return df.orderBy(F.xxhash64(row_hash(df.schema), F.lit(seed))).limit(n)


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 5
) -> DataFrame:
    """(column, rank, label, count): the k most frequent values, ties by label."""
    titles = F.array(*[F.lit(f.name) for f in _fields(df, columns)])
    ranked = _ranked_labels(value_frequencies(df, columns), k)
    return ranked.select(F.get(titles, F.col("ordinal")).alias("column"), "rank", "label", "count")


def bottom_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column, rank, label, count): the k least frequent values, ties by label
    from the last on; missing values are left out."""
    titles = F.array(*[F.lit(f.name) for f in _fields(df, columns)])
    labelled = value_frequencies(df, columns).where(F.col("value").isNotNull()).select(
        "ordinal", F.col("value").alias("label"), F.col("n").alias("count")
    )
    ranked = top_by(labelled, ["ordinal"], [F.asc("count"), F.desc("label")], k)
    return ranked.select(F.get(titles, F.col("ordinal")).alias("column"), "rank", "label", "count")


def _ranked_labels(frequencies: DataFrame, k: int) -> DataFrame:
    labelled = frequencies.select(
        "ordinal", F.coalesce("value", F.lit(NULL_LABEL)).alias("label"), F.col("n").alias("count")
    )
    return top_by(labelled, ["ordinal"], [F.desc("count"), F.asc("label")], k)


def _is_key(rows: Column, nulls: Column, unique: Column, unique_pct: Column, null_pct: Column,
            kind: Column) -> Column:
    strict = (rows > 0) & (nulls == 0) & (unique == rows) & (kind != "float")
    loose = (rows > 0) & (unique_pct >= 98.0) & (null_pct <= 5.0)
    return strict | loose


def _finish(stats: DataFrame) -> DataFrame:
    """Add the derived percentages and the key flag, in profile column order."""
    null_pct = percent(F.col("nulls"), F.col("rows"))
    unique_pct = percent(F.col("unique_count"), F.col("rows"))
    full = (
        stats.withColumn("nulls", F.col("rows") - F.col("non_null"))
        .withColumn("null_percent", null_pct)
        .withColumn("unique_percent", unique_pct)
        .withColumn(
            "is_key_candidate",
            _is_key(
                F.col("rows"), F.col("nulls"), F.col("unique_count"),
                F.col("unique_percent"), F.col("null_percent"), F.col("logical_type"),
            ),
        )
    )
    order = [f.name for f in T.StructType.fromDDL(PROFILE_SCHEMA).fields]
    return full.select(*order)


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    exact: bool = True,
    samples: int = 5,
    top_k: int = 5,
    sample: int | None = None,
    medians: bool = True,
) -> DataFrame:
    """One row per column; see ``PROFILE_SCHEMA``.

    Numeric columns carry min, max, mean and median, the others their top
    values; ``samples`` are the smallest distinct values. Either list is left
    out when its length is 0. ``sample`` profiles a repeatable sample of rows.
    """
    if sample is not None:
        df = sample_rows(df, sample)
    if not exact:
        return _approximate(df, columns, top_k)
    listed = column_list(df, columns)
    # with one consumer only, the values need not be stored
    several = medians or samples or top_k
    counted = stored_frequencies(df, columns) if several else value_frequencies(df, columns)
    value = F.col("value")
    # the number first: it spares the text of every number
    there = F.col("number").isNotNull() | value.isNotNull()
    totals = counted.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(there).alias("unique_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        (
            F.sum(F.col("number") * F.col("n"))
            / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))
        ).alias("mean"),
    )
    smallest = [F.asc("number"), F.asc("value")]
    sampled = (
        top_by(counted.where(value.isNotNull()), ["ordinal"], smallest, samples)
        .groupBy("ordinal")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
        .select("ordinal", F.col("ranked.value").alias("sample_values"))
    )
    texts = [i for i, f in enumerate(_fields(df, columns)) if not is_numeric(f.dataType)]
    ranked = (
        _ranked_labels(counted.where(F.col("ordinal").isin(texts)), top_k)
        .groupBy("ordinal")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "label", "count"))).alias("ranked"))
        .select(
            "ordinal",
            F.transform(
                "ranked", lambda r: F.struct(r["label"].alias("label"), r["count"].alias("count"))
            ).alias("top_values"),
        )
    )
    # Every side below has at most one row per column of the schema.
    out = listed.join(F.broadcast(totals), "ordinal", "left")
    if samples:
        out = out.join(F.broadcast(sampled), "ordinal", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    if top_k and texts:
        out = out.join(F.broadcast(ranked), "ordinal", "left")
    else:
        out = out.withColumn("top_values", F.lit(None).cast("array<struct<label:string,count:bigint>>"))
    if medians:
        numbers = counted.where(F.col("number").isNotNull()).select("ordinal", "number", "n")
        middle = exact_median(numbers, "ordinal")
        out = out.join(F.broadcast(middle), "ordinal", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    zeros = {name: 0 for name in ("rows", "non_null", "unique_count")}
    return _finish(out.fillna(zeros))


#: Size parameters of the sketches: distinct counts within 1 %, ranks within 0.5 %.
DISTINCT_SKETCH = 14
QUANTILE_SKETCH = 800


def distinct_sketch(f: T.StructField) -> Column:
    """Mergeable sketch of a column's distinct values, over 64-bit hashes."""
    cell = as_text(f) if logical_type(f.dataType) in ("nested", "interval") else col(f.name)
    return F.hll_sketch_agg(F.when(present(f), F.xxhash64(cell)), DISTINCT_SKETCH)


def _approximate(df: DataFrame, columns: Sequence[str] | None, top_k: int) -> DataFrame:
    """Sketch-based profile: no shuffle of rows.

    Counts and bounds compile to generated code; sketches do not and would pull
    the others out of it, so the two run as separate aggregates side by side.
    """
    fields = _fields(df, columns)
    none, no_list = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    no_top = F.lit(None).cast("array<struct<label:string,count:bigint>>")
    plain, sketches, plain_rows, sketch_rows = [F.count(F.lit(1)).alias("rows")], [], [], []
    for i, f in enumerate(fields):
        plain.append(F.count_if(present(f)).alias(f"non_null_{i}"))
        sketches.append(F.hll_sketch_estimate(distinct_sketch(f)).alias(f"unique_{i}"))
        bounds = [none.alias(s) for s in ("min", "max", "mean")]
        middle, top = none, no_top
        if is_numeric(f.dataType):
            number = as_number(f)
            plain += [
                agg(number).alias(f"{s}_{i}") for s, agg in (("min", F.min), ("max", F.max), ("mean", F.avg))
            ]
            bounds = [F.col(f"{s}_{i}").alias(s) for s in ("min", "max", "mean")]
            sketch = F.kll_sketch_agg_double(number, F.lit(QUANTILE_SKETCH))
            sketches.append(sketch.alias(f"quantiles_{i}"))
            middle = F.when(
                F.col(f"quantiles_{i}").isNotNull() & (F.kll_sketch_get_n_double(f"quantiles_{i}") > 0),
                F.kll_sketch_get_quantile_double(f"quantiles_{i}", F.lit(0.5)),
            )
        else:
            label = F.coalesce(as_text(f), F.lit(NULL_LABEL))
            sketches.append(F.call_function("approx_top_k", label, F.lit(top_k)).alias(f"top_{i}"))
            top = F.transform(
                f"top_{i}", lambda t: F.struct(t["item"].alias("label"), t["count"].alias("count"))
            )
        ordinal = F.lit(i).alias("ordinal")
        non_null = F.col(f"non_null_{i}").alias("non_null")
        plain_rows.append(F.struct(ordinal, "rows", non_null, *bounds))
        sketch_rows.append(
            F.struct(
                ordinal, F.col(f"unique_{i}").alias("estimate"), middle.alias("median"), top.alias("top_values")
            )
        )

    def unpivot(aggregates: list[Column], rows: list[Column]) -> DataFrame:
        return df.agg(*aggregates).select(F.inline(F.array(*rows)))

    # Both sides have one row per column of the schema.
    long = unpivot(plain, plain_rows).join(F.broadcast(unpivot(sketches, sketch_rows)), "ordinal")
    long = long.withColumn("unique_count", F.least("estimate", "non_null"))
    long = long.withColumn("sample_values", no_list)
    return _finish(column_list(df, columns).join(F.broadcast(long), "ordinal"))


def light_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, dtype, rows, non_null, nulls, null_percent): what drift needs, by one aggregate."""
    types = column_list(df, columns).select("column", "dtype")
    return null_profile(df, columns).join(F.broadcast(types), "column")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, mean, median) of the numeric columns."""
    chosen = [f.name for f in _fields(df, columns) if is_numeric(f.dataType)]
    return column_profile(df, chosen, samples=0, top_k=0).select("column", "min", "max", "mean", "median")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, non_null, nulls, null_percent) by one aggregate, no shuffle of rows."""
    fields = _fields(df, columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(f)).alias(f"nulls_{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(F.lit(f.name).alias("column"), "rows", F.col(f"nulls_{i}").alias("nulls"))
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*entries))).select(
        "column",
        "rows",
        (F.col("rows") - F.col("nulls")).alias("non_null"),
        "nulls",
        percent(F.col("nulls"), F.col("rows")).alias("null_percent"),
    )


def null_audit(df: DataFrame, columns: Sequence[str] | None = None, above: float = 5.0) -> DataFrame:
    """Columns whose share of missing values exceeds the threshold, at 2 decimals."""
    flagged = null_profile(df, columns)
    share = F.round(percent(F.col("nulls"), F.col("rows"), 2), 2)
    return flagged.where(F.col("nulls") * 100 > F.col("rows") * above).select(
        "column", share.alias("null_percent")
    )


def headline_metrics(df: DataFrame, k: int = 5) -> DataFrame:
    """Top values of the text columns with a headline name, with a description."""
    chosen = [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and f.name.strip().lower() in names.HEADLINE_NAMES
    ]
    if not chosen:
        schema = "column string, rank int, label string, count bigint, description string"
        return df.sparkSession.createDataFrame([], schema)
    return top_values(df, chosen, k).withColumn(
        "description", F.concat(F.lit("Most common "), F.col("column"))
    )


def leaderboard_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """(group, value) column pairs whose names suggest a leaderboard."""
    groups = [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and any(w in f.name.lower() for w in names.GROUP_WORDS)
    ]
    values = [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) and any(w in f.name.lower() for w in names.VALUE_WORDS)
    ]
    return [(g, v) for g in groups for v in values]


def leaderboards(
    df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, k: int = 5
) -> DataFrame:
    """(group, value, side, rank, label, mean): k lowest means as best, k highest as worst.

    All pairs share one scan and one shuffle of partial averages. Groups with a
    single distinct label are left out, as are missing labels and values.
    """
    pairs = leaderboard_pairs(df) if pairs is None else list(pairs)
    schema = "group string, value string, side string, rank int, label string, mean double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.array(
        *[
            F.struct(
                F.lit(g).alias("group"),
                F.lit(v).alias("value"),
                as_text(field(df, g)).alias("label"),
                as_number(field(df, v)).alias("number"),
            )
            for g, v in pairs
        ]
    )
    means = (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .where(F.col("label").isNotNull())
        .groupBy("group", "value", "label")
        .agg(F.avg("number").alias("mean"))
    )
    pair = Window.partitionBy("group", "value")
    labels = means.groupBy("group", "value").agg(F.count(F.lit(1)).alias("labels"))
    sides = labels
    for side, order in (("best", F.asc("mean")), ("worst", F.desc("mean"))):
        ranked = top_by(means.where(F.col("mean").isNotNull()), ["group", "value"], [order, F.asc("label")], k)
        sides = sides.unionByName(ranked.withColumn("side", F.lit(side)), allowMissingColumns=True)
    # At most 2k + 1 rows per pair are left here.
    counted = sides.withColumn("labels", F.max("labels").over(pair))
    return counted.where((F.col("labels") > 1) & F.col("side").isNotNull()).select(
        "group", "value", "side", "rank", "label", "mean"
    )


MOMENTS = "a int, b int, n double, mean_a double, mean_b double, var_a double, var_b double, cov double"


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7
) -> DataFrame:
    """(col_a, col_b, correlation, strong) for numeric pairs with a < b, over the rows that have both.

    One scan for any number of columns. Pairs without a correlation (fewer than two rows, a column that
    does not vary, infinite values) are left out.
    """
    chosen = sorted(f.name for f in _fields(df, columns) if is_numeric(f.dataType))
    if len(chosen) < 2:
        schema = "col_a string, col_b string, correlation double, strong boolean"
        return df.sparkSession.createDataFrame([], schema)
    long = _correlations(df, chosen)
    usable = long.where(F.col("r").isNotNull() & ~F.isnan("r"))
    return usable.select(
        "col_a",
        "col_b",
        F.round("r", 3).alias("correlation"),
        (F.abs("r") >= threshold).alias("strong"),
    )


def _correlations(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) of all pairs: co-moments of every task, a row per pair, merged around the common means.

    A task sends a row per pair whatever the number of its rows.
    """
    numbers = df.select(*[as_number(field(df, name)).alias(f"c{i}") for i, name in enumerate(chosen)])
    by_task = numbers.mapInArrow(co_moments, MOMENTS)
    pair = Window.partitionBy("a", "b")
    total = F.sum("n").over(pair)
    rows = by_task.select(
        "*",
        *[(F.col(m) - F.sum(F.col("n") * F.col(m)).over(pair) / total).alias(f"off_{m[-1]}") for m in ("mean_a", "mean_b")],
    )
    merged = rows.groupBy("a", "b").agg(
        *[F.sum(F.col(f"var_{s}") + F.col("n") * F.col(f"off_{s}") ** 2).alias(f"var_{s}") for s in "ab"],
        F.sum(F.col("cov") + F.col("n") * F.col("off_a") * F.col("off_b")).alias("cov"),
        *[F.sum(F.col("n") * F.col(f"mean_{s}") ** 2).alias(f"size_{s}") for s in "ab"],
    )
    # What is left of the rounding of equal values is no variance.
    varies = (F.col("var_a") > F.col("size_a") * 1e-26) & (F.col("var_b") > F.col("size_b") * 1e-26)
    r = F.when(varies, F.col("cov") / (F.sqrt("var_a") * F.sqrt("var_b")))
    labels = F.array(*[F.lit(name) for name in chosen])
    return merged.select(F.get(labels, F.col("a")).alias("col_a"), F.get(labels, F.col("b")).alias("col_b"), r.alias("r"))


def co_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``MOMENTS`` of each pair of columns, over the rows of a task that have both; batches merge as they come.

    Means and variances are kept per pair, for each pair has rows of its own.
    """
    state = None
    for batch in batches:
        values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
        there = np.stack([~c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        part = _batch_moments(values, there) if len(values) else None
        state = part if state is None else _merged(state, part) if part else state
    if state is not None:
        n, mean, var, cov = state
        a, b = np.nonzero(np.triu(n, 1) > 0)
        columns = [a.astype(np.int32), b.astype(np.int32), n[a, b], mean[a, b], mean[b, a], var[a, b], var[b, a], cov[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in MOMENTS.split(", ")])


def _batch_moments(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, mean, var, cov) by pair; entry [i, j] of mean and var is of column i over the rows that have both.

    Values are taken from one of their own near the mean, so that equal ones become exact zeros.
    """
    with np.errstate(all="ignore"):
        filled = np.where(there, values, 0.0)
        middle = filled.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        near = np.where(there, np.abs(values - middle), np.inf).argmin(axis=0)
        pivot = filled[near, np.arange(values.shape[1])]
        moved, mask = np.where(there, values - pivot, 0.0), there.astype(np.float64)
        n = mask.T @ mask
        rows = np.maximum(n, 1)
        sums, squares, products = moved.T @ mask, (moved**2).T @ mask, moved.T @ moved
        var = squares - sums**2 / rows
        var = np.where(var <= squares * 1e-13, 0.0, var)
        return n, sums / rows + pivot[:, None] * (n > 0), var, products - sums * sums.T / rows


def _merged(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The moments of both sets of rows."""
    (n1, mean1, var1, cov1), (n2, mean2, var2, cov2) = left, right
    with np.errstate(all="ignore"):
        rows = np.maximum(n1 + n2, 1)
        apart = np.where((n1 > 0) & (n2 > 0), mean2 - mean1, 0.0)
        weight = n1 * n2 / rows
        mean = (n1 * mean1 + n2 * mean2) / rows
        mean = np.where(apart == 0, np.where(n1 > 0, mean1, mean2), mean)
        return n1 + n2, mean, var1 + var2 + apart**2 * weight, cov1 + cov2 + apart * apart.T * weight


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max) of the datetime columns, in ISO form."""
    from feedloom.functions.numbers import iso

    dates = [f for f in _fields(df, columns) if logical_type(f.dataType) == "datetime"]
    if not dates:
        return df.sparkSession.createDataFrame([], "column string, min string, max string")
    wide = df.agg(
        *[F.min(col(f.name)).alias(f"min_{i}") for i, f in enumerate(dates)],
        *[F.max(col(f.name)).alias(f"max_{i}") for i, f in enumerate(dates)],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            iso(F.col(f"min_{i}")).alias("min"),
            iso(F.col(f"max_{i}")).alias("max"),
        )
        for i, f in enumerate(dates)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def role_hints(profile: DataFrame) -> DataFrame:
    """(column, role) from a column profile; columns without a role are left out."""
    numeric = F.col("logical_type").isin("integer", "float", "decimal")
    return profile.select("column", names.role_hint(F.col("column"), numeric).alias("role")).where(
        F.col("role").isNotNull()
    )
