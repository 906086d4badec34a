"""URL filters: expand each url into host-suffix and path-prefix expressions and look those up by digest.

Every expression is a host suffix followed by a path prefix. Expressions and rules meet in an
equi-join on the first eight hex digits of their SHA-256; the full digests then confirm the match,
and the strongest matching rule of a url decides. Only suffixes and prefixes of a length that some
rule has are made, so the number of expressions follows the rules, never the url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import UPPER, set_aside, with_row_key

#: More rules than this (about 20 MB of digests) are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 200_000
_SHORT = 8


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased.

    Null, and a url without ``://``, have an empty host.
    """
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _strength(rules: DataFrame) -> Column:
    """Tier, then length, then host length, then block over allow, packed into one long.

    For one url, no two different rules share tier, length and host length, so the winner's text can
    be cut out of the url again.
    """
    host, path = F.length("host").cast("long"), F.length("path").cast("long")
    return (
        F.shiftleft(F.lit(255) - F.col("tier").cast("long"), 49)
        + F.shiftleft(host + path, 25)
        + F.shiftleft(host, 1)
        + (F.col("verdict") == "block").cast("long")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule, tier and verdict to every row of ``pages``.

    ``rules`` has host, path, verdict (allow or block) and tier (0 to 255, 0 decides first). A rule
    fits its host and all subdomains, when the url's path starts with the rule's. Within a tier the
    longest rule (host and path) wins, then the one with the longer host, then block over allow.
    Urls that no rule fits get a null rule and the default verdict. Rules of over 16 million
    characters are refused by the packing; rules with a null in any column never match.

    Every input row gives one row: repeated rows repeat, null ids stay null, empty tables give empty
    results. Columns of ``pages`` that are called like a result column are replaced by it.
    """
    usable = rules.filter(F.greatest(*(F.col(c).isNull().cast("int") for c in ("host", "path", "verdict", "tier"))) == 0)
    usable = usable.select(
        _strength(usable).alias("_strength"),
        F.sha2(F.concat("host", "path"), 256).alias("_digest"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_chars"),
    )
    shape = usable.agg(
        F.collect_set("_labels").alias("labels"), F.collect_set("_chars").alias("chars"), F.count("*").alias("n")
    ).first()
    lookup = usable.select("_digest", "_strength").withColumn("_short", F.left("_digest", F.lit(_SHORT)))
    if shape["n"] <= BROADCAST_RULES:
        lookup = F.broadcast(lookup)
    lookup = lookup.withColumnRenamed("_digest", "_rule_digest")

    made = {"host", "path", "rule", "tier", "verdict"}
    pages, back, (url,) = set_aside(pages, url)
    kept = [c for c in pages.columns if c not in made]
    parts = with_row_key(pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), "_row")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, sorted(shape["labels"]))).cast("array<int>"), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, sorted(shape["chars"]))).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.left("path", n),
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    keys = parts.select("_row", "host", "path", F.explode_outer(both).alias("_expression"))
    keys = keys.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_short", F.left("_digest", F.lit(_SHORT)))
    fits = F.when(F.col("_digest") == F.col("_rule_digest"), F.col("_strength"))
    winner = keys.join(lookup, "_short", "left").groupBy("_row").agg(F.max(fits).alias("_won"))

    length, own = F.shiftright("_won", 25).bitwiseAND(0xFFFFFF), F.shiftright("_won", 1).bitwiseAND(0xFFFFFF)
    rule = F.concat(F.right("host", own.cast("int")), F.left("path", (length - own).cast("int")))
    return (
        parts.join(winner, "_row", "left")
        .withColumn("rule", F.when(F.col("_won").isNotNull(), rule))
        .withColumn("tier", (F.lit(255) - F.shiftright("_won", 49)).cast("int"))
        .withColumn(
            "verdict",
            F.when(F.col("_won").isNull(), default).when(F.col("_won") % 2 == 1, "block").otherwise("allow"),
        )
        .drop("_row", "_won")
        .withColumnsRenamed(back)
    )
