"""Refresh jobs: take in what is new in a folder, once, then stop.

An outside scheduler starts the refresh; the checkpoint remembers the files
already taken. Every write is keyed by the batch id, so a batch that is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.latest import last_per_group
from feedloom.operators.profile import QUANTILE_SKETCH, distinct_sketch
from feedloom.operators.steps import Context, Step, run_steps
from feedloom.sources.snapshots import merge_snapshot, snapshots
from feedloom.types import as_number, as_text, is_numeric, missing

#: Values whose counts a partial profile keeps per column.
TRACKED_VALUES = 4096
#: A longer value is kept as its beginning and a digest of the whole.
LONGEST_LABEL = 256


def _write_batch(df: DataFrame, batch_id: int, target: str) -> None:
    if "batch_id" in df.columns:
        raise ValueError("the column name 'batch_id' is reserved for the batch that brought a row")
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(target)


def _run_once(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str, checkpoint: str, on_batch,
    files_per_batch: int | None,
) -> None:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    query = (
        reader.load(folder)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def refresh_feed(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    steps: Sequence[Step] = (),
    *,
    context: Context | None = None,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> None:
    """Clean the new files of a folder into ``target``; a second run adds nothing.

    Steps see one batch at a time; a de-duplication therefore holds within a
    batch, and :func:`read_refreshed` with keys holds across batches. A column
    called ``batch_id`` is an error.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(run_steps(batch, steps, context), batch_id, target)

    _run_once(spark, folder, schema, fmt, checkpoint, on_batch, files_per_batch)


def read_refreshed(spark: SparkSession, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of a refreshed feed; with keys, one row per key.

    The row of the newest batch stays, within a batch the last by all other columns in their order.
    """
    rows = spark.read.parquet(target)
    if keys:
        others = [c for c in rows.columns if c not in keys and c != "batch_id"]
        rows = last_per_group(rows, keys, ["batch_id", *others])
    return rows.drop("batch_id")


def merge_batch(
    batch: DataFrame, batch_id: int, root: str, keys: Sequence[str], order_by: Sequence[str] | None = None
) -> None:
    """Merge one batch into a keyed table, once: a batch whose snapshot is published changes nothing."""
    label = f"batch {batch_id}"
    if snapshots(batch.sparkSession, root).where(F.col("label") == label).isEmpty():
        merge_snapshot(batch, root, keys, order_by, label=label)


def refresh_keyed(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    root: str,
    checkpoint: str,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    steps: Sequence[Step] = (),
    *,
    context: Context | None = None,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> None:
    """Keep one row per key of a folder's files, compacted as they come; read it with ``read_snapshot``.

    The row of the newest batch stays, within a batch the last by ``order_by`` (by all other columns in
    their order where it is not given). A batch rewrites only the key buckets it touches, so reading
    costs a scan of the kept rows, however many batches there were.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        merge_batch(run_steps(batch, steps, context), batch_id, root, keys, order_by)

    _run_once(spark, folder, schema, fmt, checkpoint, on_batch, files_per_batch)


def _label(f: T.StructField) -> Column:
    text = as_text(f)
    cut = F.concat(F.substring(text, 1, LONGEST_LABEL - 17), F.lit("#"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    return F.when(~missing(f), F.when(F.length(text) > LONGEST_LABEL, cut).otherwise(text))


def partial_profile(df: DataFrame) -> DataFrame:
    """Mergeable facts per column: counts, nulls, min, max, sum; sketches of distinct values, quantiles, frequent values."""
    fields = df.schema.fields
    df = df.select("*", *[_label(f).alias(f"__label_{i}") for i, f in enumerate(fields)])
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        number = as_number(f) if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggregates += [
            F.count_if(missing(f)).alias(f"nulls_{i}"),
            F.min(number).alias(f"min_{i}"),
            F.max(number).alias(f"max_{i}"),
            F.sum(number).alias(f"sum_{i}"),
            distinct_sketch(f).alias(f"sketch_{i}"),
            F.kll_sketch_agg_double(number, F.lit(QUANTILE_SKETCH)).alias(f"quantiles_{i}"),
            F.expr(f"approx_top_k_accumulate(__label_{i}, {TRACKED_VALUES}) FILTER (WHERE __label_{i} IS NOT NULL)").alias(f"frequent_{i}"),
        ]
    wide = df.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows"),
            *[F.col(f"{s}_{i}").alias(s) for s in ("nulls", "min", "max", "sum", "sketch", "quantiles", "frequent")],
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def merge_profiles(partials: DataFrame, top_k: int = 10) -> DataFrame:
    """One profile from the partials of all batches; a partial has one row per column.

    The median's rank is within one in a hundred of the middle; top values (label and count, most
    frequent first) are exact in columns of at most 4,096 different values, and beyond that their counts
    are at most one row in a thousand too high.
    """
    merged = partials.groupBy("ordinal", "column").agg(
        F.max_by("dtype", "batch_id").alias("dtype"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("sum").alias("sum"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED_VALUES})").alias("frequent"),
    )
    counted = F.transform(F.expr(f"approx_top_k_estimate(frequent, {top_k})"), lambda v: F.struct((-v["count"]).alias("n"), v["item"].alias("label")))
    top = F.transform(F.array_sort(counted), lambda v: F.struct(v["label"].alias("label"), (-v["n"]).alias("count")))
    non_null: Column = F.col("rows") - F.col("nulls")
    return merged.select(
        "ordinal",
        "column",
        "dtype",
        "rows",
        non_null.alias("non_null"),
        "nulls",
        "min",
        "max",
        F.when(non_null > 0, F.col("sum") / non_null).alias("mean"),
        F.least("estimate", non_null).alias("approx_unique"),
        F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("approx_median"),
        top.alias("top_values"),
    )


def refresh_profile(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    state: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Profile only the new files, keep their partials, return the merged profile."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(partial_profile(batch).coalesce(1), batch_id, state)

    _run_once(spark, folder, schema, fmt, checkpoint, on_batch, files_per_batch)
    return merge_profiles(spark.read.parquet(state))
