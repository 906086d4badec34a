"""Foreign-key candidates between feeds, by similarity of column names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.names import looks_like_id
from feedloom.operators.profile import top_by

THRESHOLD = 0.78


@F.pandas_udf(T.DoubleType())
def name_similarity(own: pd.Series, other: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two names."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(own, other)])


def _prefix_tokens(names: DataFrame, name: str) -> DataFrame:
    """The few rarest character tokens of each name that any similar name must share one of.

    A ratio of at least t needs 2·m >= t·(a+b) shared characters m, and m is at
    most the shorter length, so the other name has at least a·t/(2-t) characters
    and m >= a·t/(2-t). Two sets sharing m tokens must meet in the first
    a - ceil(m) + 1 tokens under one common order; rare tokens come first, so
    frequent characters do not build large groups.
    """
    chars = F.split(F.col(name), "")
    # The k-th occurrence of a character is a token of its own.
    counted = F.transform(
        chars,
        lambda c, i: F.concat(
            c, F.lit("#"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")
        ),
    )
    tokens = names.select(name, F.length(name).alias("size"), F.explode(counted).alias("token"))
    return tokens


def similar_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(own, other, similarity) for distinct lower-cased names; exact, without a cross join."""
    both = left.select(F.col("own").alias("name")).union(right.select(F.col("other").alias("name")))
    tokens = _prefix_tokens(both.distinct(), "name")
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    least = F.ceil(F.col("size") * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    position = F.row_number().over(Window.partitionBy("name").orderBy("uses", "token"))
    prefix = (
        tokens.join(rarity, "token")
        .withColumn("position", position)
        .where(F.col("position") <= F.col("size") - least + 1)
        .select("name", "size", "token")
    )
    mine = prefix.join(left, F.col("name") == F.col("own"), "left_semi").select(
        F.col("name").alias("own"), F.col("size").alias("own_size"), "token"
    )
    theirs = prefix.join(right, F.col("name") == F.col("other"), "left_semi").select(
        F.col("name").alias("other"), F.col("size").alias("other_size"), "token"
    )
    shortest = F.least("own_size", "other_size")
    pairs = (
        mine.join(theirs, "token")
        .where(2 * shortest >= F.lit(threshold - 1e-9) * (F.col("own_size") + F.col("other_size")))
        .select("own", "other")
        .distinct()
    )
    scored = pairs.withColumn("similarity", name_similarity("own", "other"))
    return scored.where(F.col("similarity") >= threshold)


def foreign_key_candidates(
    profiles: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD, keep: int = 5
) -> DataFrame:
    """(feed, column, rank, other_feed, other_column, similarity).

    ``profiles`` has feed, column and is_key_candidate; ``catalog`` has feed and
    column. Id-like columns that are not keys themselves are matched with the
    columns of other feeds. Each pair of distinct names is compared once,
    however many feeds use them.
    """
    own = profiles.where(~F.col("is_key_candidate") & looks_like_id(F.col("column"))).select(
        "feed", "column", F.lower("column").alias("own")
    )
    other = catalog.select(
        F.col("feed").alias("other_feed"),
        F.col("column").alias("other_column"),
        F.lower("column").alias("other"),
    )
    scored = similar_names(own.select("own").distinct(), other.select("other").distinct(), threshold)
    matched = (
        own.join(scored, "own")
        .join(other, "other")
        .where(F.col("feed") != F.col("other_feed"))
        .withColumn("similarity", F.round("similarity", 3))
    )
    order = [F.desc("similarity"), F.asc("other_feed"), F.asc("other_column")]
    return top_by(matched, ["feed", "column"], order, keep).select(
        "feed", "column", "rank", "other_feed", "other_column", "similarity"
    )
