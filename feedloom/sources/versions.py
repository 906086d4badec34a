"""What to do with incoming files, by digest against the latest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.latest import last_per_group


def decide_versions(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """(feed, digest, action, version) per incoming (feed, digest, confirmed).

    No version yet: ``create``. Same digest as the latest: ``reuse`` it.
    Otherwise ``new_version`` when confirmed, else ``conflict`` with the latest.
    """
    latest = last_per_group(versions, ["feed"], ["version"]).select(
        "feed", F.col("version").alias("latest"), F.col("digest").alias("latest_digest")
    )
    same = F.col("digest") == F.col("latest_digest")
    action = (
        F.when(F.col("latest").isNull(), "create")
        .when(same, "reuse")
        .when(F.col("confirmed"), "new_version")
        .otherwise("conflict")
    )
    joined = incoming.join(latest, "feed", "left").withColumn("action", action)
    step = F.when(F.col("action").isin("create", "new_version"), 1).otherwise(0)
    version = F.coalesce("latest", F.lit(0)) + step
    return joined.select("feed", "digest", "action", version.cast("int").alias("version"))
