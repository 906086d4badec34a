"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (columns a, b); component is the smallest node reachable.

    Links with a null end are left out; loops and repeated links are harmless. Each round is two
    aggregations and two joins over the links that are left, written to the shared folder, and the
    rounds end when the link table stays as it is, after some log(n) of them. Nodes must be of one
    orderable type. A node with very many links is spread by the shuffle's salt-free minimum, which is
    summed up map-side, and by run-time splitting of the join.
    """
    live = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = materialize(live.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        stars = materialize(small.filter("a <> b").distinct(), "links")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
