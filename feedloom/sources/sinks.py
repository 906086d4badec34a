"""Writers: versioned tables, load strategies, incremental loads."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import session
from feedloom.operators.joins import upsert
from feedloom.operators.latest import last_per_group

NAME_LENGTH = 60


def table_name(feed: str, version: int, prefix: str = "feed_") -> str:
    """Table name of a feed version, safe characters only, at most 60 long.

    A feed name too long for that is cut and marked by a digest of the whole name; the version stays.
    """
    slug = re.sub(r"[^a-z0-9_]", "_", feed.lower()).strip("_") or "feed"
    name, ending = f"{prefix}{slug}", f"_v{version}"
    if len(name) + len(ending) > NAME_LENGTH:
        ending = f"_{hashlib.sha256(feed.encode()).hexdigest()[:8]}{ending}"
        name = name[: NAME_LENGTH - len(ending)]
    return name + ending


def write_version(
    df: DataFrame, root: str, feed: str, version: int, max_rows: int | None = None
) -> dict[str, object] | None:
    """Write one feed version below ``root`` and publish it.

    Each call writes to a folder of its own; the marker that publishes a version names that folder.
    An empty table, or one above ``max_rows``, is removed again and not published, so a failed or
    rejected write changes nothing that readers see, and rewriting a version switches them at once.
    Rows are counted from the written files' footers.
    """
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    target = f"{version_path(root, feed, version)}/attempt={attempt}"
    df.write.parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).count()
    if rows == 0 or (max_rows and rows > max_rows):
        session.remove(spark, target)
        return None
    entry = [(feed, version, table_name(feed, version), rows, len(df.columns), target, time.time_ns())]
    marker = spark.createDataFrame(entry, PUBLISHED)
    marker.coalesce(1).write.json(f"{root}/_published/{_slug(feed)}/{version}-{attempt}")
    return {"path": target, "table": entry[0][2], "rows": rows, "columns": len(df.columns)}


def _slug(feed: str) -> str:
    """A folder name for a feed, a different one for each: odd bytes as ``~`` and two hex digits."""
    return re.sub(rb"[^A-Za-z0-9-]", lambda m: b"~%02x" % m[0][0], feed.encode()).decode() or "~"


def version_path(root: str, feed: str, version: int) -> str:
    return f"{root}/data/feed={_slug(feed)}/version={version}"


PUBLISHED = (
    "feed string, version int, table string, rows bigint, columns int, path string, published_at bigint"
)


def published(spark: SparkSession, root: str) -> DataFrame:
    """(feed, version, table, rows, columns, path, published_at): each version as it was published last."""
    markers = spark.read.schema(PUBLISHED).option("recursiveFileLookup", True).json(f"{root}/_published")
    return last_per_group(markers, ["feed", "version"], ["published_at", "path"])


def read_version(spark: SparkSession, root: str, feed: str, version: int | None = None) -> DataFrame:
    """A published version of a feed, the newest unless one is named."""
    known = published(spark, root).where(F.col("feed") == feed)
    if version is not None:
        known = known.where(F.col("version") == version)
    newest = known.orderBy(F.desc("version")).select("path").first()
    if newest is None:
        raise ValueError(f"no such version of feed {feed!r}")
    return spark.read.parquet(newest["path"])


def load(df: DataFrame, path: str, strategy: str = "append") -> None:
    modes = {"append": "append", "replace": "overwrite"}
    if strategy not in modes:
        raise ValueError(f"load strategy must be one of {sorted(modes)}")
    df.write.mode(modes[strategy]).parquet(path)


def load_incremental(
    old: DataFrame, new: DataFrame, keys: Sequence[str], label: str = "merged", order_by: Sequence[str] | None = None
) -> DataFrame:
    """Merge new rows into old ones by key and store the result in the shared folder.

    Of new rows with the same key the last by ``order_by`` wins, by all other columns in their order
    where it is not given. The old table stays as it is until the caller switches to the new one, so a
    failed job leaves no half-merged table.
    """
    order = order_by or [c for c in new.columns if c not in keys] or list(keys)
    return session.materialize(upsert(old, new, keys, order), label)
