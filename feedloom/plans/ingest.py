"""Ingest of a feed as one operation: fingerprint, version decision, write, profile, drift, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import session
from feedloom.operators.drift import drift_summary
from feedloom.operators.profile import column_profile
from feedloom.operators.quality import generate_rules
from feedloom.sources.files import table_fingerprint
from feedloom.sources.sinks import published, write_version
from feedloom.sources.versions import decide_versions

DIGESTS = "feed string, version int, digest string, attempt string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def known_digests(spark: SparkSession, root: str) -> DataFrame:
    """(feed, version, digest) of published versions, as they were published last."""
    if not _exists(spark, f"{root}/_digests"):
        return session.literal_rows(spark, [], "feed string, version int, digest string")
    logged = spark.read.schema(DIGESTS).option("recursiveFileLookup", True).json(f"{root}/_digests")
    live = published(spark, root).select("feed", "version", F.col("path").alias("attempt"))
    return logged.join(live, ["feed", "version", "attempt"]).select("feed", "version", "digest")


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-profile")


def stored_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-rules")


def ingest(
    df: DataFrame, root: str, feed: str, *, confirmed: bool = False, max_rows: int | None = None
) -> dict[str, object]:
    """Take a frame in as the next version of a feed; returns what was decided and found.

    The content's fingerprint decides: the same as the newest version is ``reuse``, a change that is
    not ``confirmed`` is a ``conflict``, and neither writes. Otherwise the version is written and
    published, and its profile and rules are stored beside it; ``drift`` compares with the profile
    stored for the version before. An empty frame, or one above ``max_rows``, is ``rejected``.
    """
    spark = df.sparkSession
    digest = table_fingerprint(df).first()["digest"]
    incoming = session.literal_rows(spark, [(feed, digest, confirmed)], "feed string, digest string, confirmed boolean")
    known = known_digests(spark, root).where(F.col("feed") == feed)
    decision = decide_versions(incoming, known).first()
    found: dict[str, object] = {"feed": feed, "digest": digest, "action": decision["action"], "version": decision["version"]}
    if decision["action"] in ("reuse", "conflict"):
        return found
    before = None
    if decision["version"] > 1:
        older = published(spark, root).where((F.col("feed") == feed) & (F.col("version") == decision["version"] - 1))
        before = stored_profile(spark, older.first()["path"])
    info = write_version(df, root, feed, decision["version"], max_rows)
    if info is None:
        return {**found, "action": "rejected"}
    path = info["path"]
    column_profile(spark.read.schema(df.schema).parquet(path)).write.parquet(f"{path}-profile")
    profile = stored_profile(spark, path)
    generate_rules(profile).write.parquet(f"{path}-rules")
    entry = session.literal_rows(spark, [(feed, decision["version"], digest, path)], DIGESTS)
    entry.coalesce(1).write.mode("append").json(f"{root}/_digests")
    drift = drift_summary(before, profile).first().asDict()
    return {**found, "path": path, "rows": info["rows"], "drift": drift, "rules": stored_rules(spark, path).count()}
