"""Joins, upserts, latest rows, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import joins, latest
from feedloom.sources import catalog
from feedloom.suite.profiling import VERSIONS_SQL, order_versions
from feedloom.suite.registry import query, table

# One nation key is missing on the right, all customers of one nation on the left.
LEFT_SQL = "SELECT c_custkey, nullif(c_nationkey, 3) AS nation, c_mktsegment AS name FROM customer"
RIGHT_SQL = "SELECT nullif(n_nationkey, 7) AS nation, n_name AS name, n_regionkey FROM nation"


def _sides(spark, sf_dir):
    left = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "nullif(c_nationkey, 3) AS nation", "c_mktsegment AS name"
    )
    right = table(spark, sf_dir, "nation").selectExpr(
        "nullif(n_nationkey, 7) AS nation", "n_name AS name", "n_regionkey"
    )
    return left, right


def _join_sql(how: str) -> str:
    return f"""
    SELECT c_custkey, coalesce(l.nation, r.nation) AS nation, l.name AS name, r.name AS name_right, n_regionkey
    FROM ({LEFT_SQL}) l {how} JOIN ({RIGHT_SQL}) r ON l.nation IS NOT DISTINCT FROM r.nation
    """


@query("join_left_null_safe", _join_sql("LEFT"))
def join_left(spark, sf_dir):
    return joins.join_tables(*_sides(spark, sf_dir), ["nation"], how="left")


@query("join_inner_null_safe", _join_sql("INNER"))
def join_inner(spark, sf_dir):
    return joins.join_tables(*_sides(spark, sf_dir), ["nation"], how="inner")


@query("join_right_null_safe", _join_sql("RIGHT"))
def join_right(spark, sf_dir):
    return joins.join_tables(*_sides(spark, sf_dir), ["nation"], how="right")


@query("join_outer_null_safe", _join_sql("FULL"))
def join_outer(spark, sf_dir):
    return joins.join_tables(*_sides(spark, sf_dir), ["nation"], how="outer")


@query(
    "join_plain_equality",
    f"""
    SELECT c_custkey, l.nation AS nation, l.name AS name, r.name AS name_right, n_regionkey
    FROM ({LEFT_SQL}) l LEFT JOIN ({RIGHT_SQL}) r ON l.nation = r.nation
    """,
)
def join_plain(spark, sf_dir):
    return joins.join_tables(*_sides(spark, sf_dir), ["nation"], how="left", null_safe=False)


@query(
    "join_multi_key",
    """
    SELECT l_orderkey, l_suppkey, l_linenumber, s_nationkey, s_acctbal
    FROM lineitem JOIN (SELECT s_suppkey, (s_suppkey % 7 + 1)::INTEGER AS line, s_nationkey, s_acctbal FROM supplier)
    ON l_suppkey = s_suppkey AND l_linenumber = line
    """,
)
def join_multi_key(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "CAST(s_suppkey % 7 + 1 AS INT) AS line", "s_nationkey", "s_acctbal"
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    joined = joins.join_tables(lines, supplier, ["l_suppkey", "l_linenumber"], ["s_suppkey", "line"], "inner")
    return joined.select("l_orderkey", "l_suppkey", "l_linenumber", "s_nationkey", "s_acctbal")


@query(
    "join_right_projection",
    """
    SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def join_right_projection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer")
    return joins.join_tables(
        orders, customer, ["o_custkey"], ["c_custkey"], select=["c_custkey", "c_mktsegment"]
    )


@query(
    "upsert_by_key",
    """
    WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
    fresh AS (SELECT o_orderkey, 'N' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders
              WHERE o_orderstatus <> 'F')
    SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fresh)
    UNION ALL SELECT * FROM fresh
    """,
)
def upsert_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderstatus <> 'F'").select(
        "o_orderkey", F.lit("N").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice")
    )
    return joins.upsert(orders.where("o_orderstatus <> 'P'"), new, ["o_orderkey"])


@query(
    "upsert_last_wins",
    """
    WITH old AS (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    fresh AS (SELECT l_orderkey, l_quantity FROM (
      SELECT l_orderkey, l_quantity, row_number() OVER (
        PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_quantity DESC) AS r
      FROM lineitem WHERE l_returnflag = 'N') WHERE r = 1)
    SELECT * FROM old WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fresh)
    UNION ALL SELECT * FROM fresh
    """,
)
def upsert_last_wins(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    old = items.where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    new = items.where("l_returnflag = 'N'").select("l_orderkey", "l_quantity", "l_shipdate")
    newest = latest.last_per_group(new, ["l_orderkey"], ["l_shipdate", "l_quantity"]).drop("l_shipdate")
    return joins.upsert(old, newest, ["l_orderkey"])


DEDUP_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
DEDUP_COLUMNS = ["l_orderkey", "l_linenumber", *DEDUP_ORDER]


def _dedup_sql(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in DEDUP_ORDER)
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS r FROM lineitem)
    WHERE r = 1
    """


def _dedup(spark, sf_dir, keep):
    items = table(spark, sf_dir, "lineitem").select(*DEDUP_COLUMNS)
    kept = latest.deduplicate(items, ["l_orderkey", "l_linenumber"], keep, DEDUP_ORDER)
    return kept.drop("l_shipdate")


@query("dedup_first", _dedup_sql("ASC"))
def dedup_first(spark, sf_dir):
    return _dedup(spark, sf_dir, "first")


@query("dedup_last", _dedup_sql("DESC"))
def dedup_last(spark, sf_dir):
    return _dedup(spark, sf_dir, "last")


@query(
    "dedup_any",
    """
    SELECT l_orderkey, l_linenumber, any_value(l_partkey) AS l_partkey, any_value(l_suppkey) AS l_suppkey,
           any_value(l_extendedprice) AS l_extendedprice
    FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1
    """,
)
def dedup_any(spark, sf_dir):
    return _dedup(spark, sf_dir, "any")


@query(
    "duplicate_groups",
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_groups(spark, sf_dir):
    return latest.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "latest_version",
    f"""
    SELECT feed, version, row_count FROM ({VERSIONS_SQL})
    QUALIFY row_number() OVER (PARTITION BY feed ORDER BY version DESC) = 1
    """,
)
def latest_version(spark, sf_dir):
    return latest.latest_version(order_versions(spark, sf_dir), "feed")


@query(
    "feed_latest_version",
    f"""
    SELECT f.feed, v.version, v.row_count FROM (SELECT DISTINCT o_orderpriority AS feed FROM orders
      UNION ALL SELECT DISTINCT c_mktsegment FROM customer) f
    LEFT JOIN (SELECT * FROM ({VERSIONS_SQL})
               QUALIFY row_number() OVER (PARTITION BY feed ORDER BY version DESC) = 1) v ON f.feed = v.feed
    """,
)
def feed_latest_version(spark, sf_dir):
    priorities = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("feed")).distinct()
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("feed")).distinct()
    return catalog.latest_feeds(priorities.union(segments), order_versions(spark, sf_dir))


@query(
    "recent_questions",
    """
    SELECT role, text, last_asked, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY role ORDER BY last_asked DESC, text) AS rank FROM (
        SELECT role, text, max(conv_id * 1000 + turn) AS last_asked FROM conversations GROUP BY 1, 2))
    WHERE rank <= 10
    """,
)
def recent_questions(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return latest.recent_distinct(log, "role", "text", "at")
