"""Tables that change by keyed merges and are read as whole snapshots.

Rows lie in buckets by a hash of their key. A merge writes the buckets it touches to a folder of its own and
then publishes a manifest, one small file that names the folder of every bucket; folders of untouched buckets
are named again, not copied. Readers take a manifest and see its snapshot whole: before the manifest is there
they see the old one, and a merge that stops anywhere before leaves files that nothing names. Older
snapshots stay readable. A table has one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import session
from feedloom.operators.latest import last_per_group
from feedloom.types import col

MANIFEST = "snapshot bigint, label string, buckets int, bucket int, path string, schema string"
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per snapshot and bucket: snapshot, label, buckets, bucket, path, schema; bucket -1 stands for the snapshot itself."""
    if not _exists(spark, f"{root}/_manifests"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/_manifests")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot, label) of every merge, oldest first by number."""
    return manifests(spark, root).where("bucket = -1").select("snapshot", "label")


def _manifest(spark: SparkSession, root: str, snapshot: int | None = None) -> list:
    """The rows of one manifest, at most one per bucket and one for the table; empty where there is none."""
    known = manifests(spark, root)
    if snapshot is None:
        snapshot = known.agg(F.max("snapshot")).first()[0]
    return known.where(F.col("snapshot") == snapshot).collect() if snapshot is not None else []


def _read(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """The rows of a snapshot, the newest unless one is named; columns added later are null in older files."""
    rows = _manifest(spark, root, snapshot)
    if not rows:
        raise ValueError(f"no such snapshot at {root!r}")
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    return _read(spark, schema, [r["path"] for r in rows if r["bucket"] >= 0])


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*map(col, keys)), F.lit(buckets)).cast("int")


def merge_snapshot(
    new: DataFrame, root: str, keys: Sequence[str], order_by: Sequence[str] | None = None, *,
    label: str = "", gone: Column | None = None, buckets: int = BUCKETS,
) -> int:
    """Merge rows into the table at ``root`` by key and publish the result; returns the snapshot's number.

    Old rows with a key of the new ones go (null keys are equal), and so do those for which ``gone`` holds;
    of new rows with one key the last by ``order_by`` stays, by all other columns in order where it is not
    given. Only buckets with such rows are read and written again. Old columns that the new rows lack
    are null in them. ``buckets`` counts when the table is made.
    """
    spark = new.sparkSession
    before = _manifest(spark, root)
    buckets = before[0]["buckets"] if before else buckets
    order = order_by or [c for c in new.columns if c not in keys] or list(keys)
    once = session.materialize(last_per_group(new, keys, order), "merge").withColumn("_bucket", _bucket(keys, buckets))
    paths = {r["bucket"]: r["path"] for r in before if r["bucket"] >= 0}
    fields = list(new.schema.fields)
    if before:
        old_fields = T.StructType.fromJson(json.loads(before[0]["schema"])).fields
        fields += [f for f in old_fields if f.name not in new.columns]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    touched = {r["_bucket"] for r in once.select("_bucket").distinct().collect()}  # a row per bucket at most
    if gone is not None and paths:
        held = _read(spark, schema, list(paths.values())).where(gone).select(_bucket(keys, buckets).alias("_bucket"))
        touched |= {r["_bucket"] for r in held.distinct().collect()}
    old = _read(spark, schema, [paths[b] for b in sorted(touched) if b in paths])
    if gone is not None:
        old = old.where(~F.coalesce(gone, F.lit(False)))
    marks = once.select(*[col(k).alias(f"__n{i}") for i, k in enumerate(keys)])
    same = reduce(lambda p, q: p & q, [old[f"`{k}`"].eqNullSafe(marks[f"__n{i}"]) for i, k in enumerate(keys)])
    kept = old.join(marks, same, "left_anti").withColumn("_bucket", _bucket(keys, buckets))
    attempt = f"{root}/data/attempt={uuid.uuid4().hex}"
    merged = once.unionByName(kept, allowMissingColumns=True).select(*map(col, schema.names), "_bucket")
    merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(attempt)
    written = _written(spark, attempt)
    after = {b: p for b, p in paths.items() if b not in touched} | {b: f"{attempt}/_bucket={b}" for b in written}
    number = max(time.time_ns(), max((r["snapshot"] for r in before), default=0) + 1)
    _publish(spark, root, number, label, buckets, after, schema)
    return number


def _written(spark: SparkSession, attempt: str) -> list[int]:
    """The buckets that an attempt has rows of, by its folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(attempt)
    names = (f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place))
    return [int(name.partition("=")[2]) for name in names if name.startswith("_bucket=")]


def _publish(spark: SparkSession, root: str, number: int, label: str, buckets: int, paths: dict[int, str], schema: T.StructType) -> None:
    """The switch: a manifest is there as one whole file or not at all."""
    rows = [(number, label, buckets, bucket, path, schema.json()) for bucket, path in [(-1, ""), *sorted(paths.items())]]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{root}/_manifests/{number:020d}")
