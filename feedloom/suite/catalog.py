"""Catalog views joined with what the tables hold."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions import names
from feedloom.operators.profile import column_profile, null_profile, role_hints
from feedloom.operators.related import foreign_key_candidates
from feedloom.sources import catalog
from feedloom.suite.registry import query, table, union_sql

TABLES = {
    "sales": ("customer", "lineitem", "orders", "part", "supplier"),
    "web": ("conversations", "documents", "events", "labels", "pages"),
}
ALL = [(schema, name) for schema, members in TABLES.items() for name in members]


def _catalog(spark, sf_dir) -> DataFrame:
    parts = [
        catalog.catalog_columns({n: table(spark, sf_dir, n) for n in members}, schema)
        for schema, members in TABLES.items()
    ]
    return parts[0].unionAll(parts[1])


def _filled(spark, sf_dir) -> DataFrame:
    """Rows and missing values of every column of every table."""
    parts = [
        null_profile(table(spark, sf_dir, n)).select(
            F.lit(schema).alias("schema"), F.lit(n).alias("table"), "column", "rows", "nulls"
        )
        for schema, n in ALL
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _counts(spark, sf_dir) -> DataFrame:
    """Rows of every table, from the files' footers."""
    parts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n)) for _, n in ALL]
    return reduce(DataFrame.unionAll, parts)


COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "conversations": "conv_id turn role text",
    "documents": "doc_id text lang source n_chars",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "pages": "page_id url html",
}
_COUNTS_SQL = union_sql([f"SELECT '{n}' AS t, count(*) AS rows FROM {n}" for _, n in ALL])


@query(
    "catalog_inventory",
    f"""
    SELECT v."schema", v."table", v.columns, v.column_count::BIGINT AS column_count, c.rows FROM (VALUES """
    + ", ".join(
        f"('{s}', '{n}', '{','.join(COLUMNS[n].split()[:6])}', {len(COLUMNS[n].split())})" for s, n in ALL
    )
    + f""") AS v("schema", "table", columns, column_count) JOIN ({_COUNTS_SQL}) c ON v."table" = c.t
    """,
)
def catalog_inventory(spark, sf_dir):
    listed = catalog.inventory(_catalog(spark, sf_dir), max_columns=6)
    rows = _counts(spark, sf_dir)
    joined = listed.join(rows, "table")
    return joined.select("schema", "table", F.array_join("columns", ",").alias("columns"), "column_count", "rows")


@query(
    "catalog_preview",
    """
    SELECT 'sales' AS "schema", 5::BIGINT AS table_count, 'customer,lineitem,orders,part,supplier' AS tables,
           (SELECT sum(rows) FROM (%s))::BIGINT AS rows
    """
    % union_sql([f"SELECT count(*) AS rows FROM {n}" for n in TABLES["sales"]]),
)
def catalog_preview(spark, sf_dir):
    allowed = catalog.granted(_catalog(spark, sf_dir), [" Sales", "SALES", "finance"])
    shown = catalog.inventory_preview(allowed)
    per_table = _filled(spark, sf_dir).groupBy("schema", "table").agg(F.max("rows").alias("rows"))
    rows = per_table.groupBy("schema").agg(F.sum("rows").alias("rows"))
    return shown.join(rows, "schema").select(
        "schema", "table_count",
        F.array_join(F.transform("tables", lambda t: t["table"]), ",").alias("tables"), "rows",
    )


@query(
    "role_hints",
    """
    SELECT 'o_orderstatus' AS "column", 'status' AS role, count(*) AS rows, count(DISTINCT o_orderstatus) AS unique_count FROM orders
    UNION ALL SELECT 'o_totalprice', 'cost', count(*), count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 'handler_name', 'agent', count(*), count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'age_days', 'duration', count(*), count(DISTINCT o_custkey) FROM orders
    """,
)
def role_hints_query(spark, sf_dir):
    named = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority AS handler_name",
        "o_custkey AS age_days", "CAST(o_orderdate AS STRING) AS ship_time",
    )
    found = column_profile(named, medians=False, samples=0, top_k=0)
    return role_hints(found).join(found.select("column", "rows", "unique_count"), "column")


@query(
    "dataset_tags",
    """
    SELECT 'events' AS "table", 'status-tracking,temporal' AS tags, count(*) AS rows FROM events
    UNION ALL SELECT 'orders', 'geospatial,location,temporal', count(*) FROM orders
    """,
)
def dataset_tags_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", "ts AS event_time", "event_type AS state")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS zip", "o_totalprice AS lat", "o_custkey AS lng", "o_orderdate AS order_date"
    )
    parts = [
        null_profile(df).select(F.lit(name).alias("table"), "column", "rows")
        for name, df in (("events", events), ("orders", orders))
    ]
    tagged = parts[0].unionAll(parts[1]).groupBy("table").agg(
        names.dataset_tags(F.col("column")).alias("tags"), F.max("rows").alias("rows")
    )
    return tagged.withColumn("tags", F.array_join("tags", ","))


@query(
    "id_columns",
    union_sql(
        [
            f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM {n}"
            for _, n in ALL
            for c in COLUMNS[n].split()
            if "id" in c.split("_")
        ]
    ),
)
def id_columns(spark, sf_dir):
    return _filled(spark, sf_dir).where(names.looks_like_id(F.col("column"))).drop("schema")


@query(
    "feed_columns",
    """
    SELECT 'orders' AS feed, c AS "column", t AS dtype, (SELECT count(*) FROM orders) AS rows
    FROM (VALUES ('o_orderkey', 'bigint'), ('o_totalprice', 'double')) v(c, t)
    """,
)
def feed_columns(spark, sf_dir):
    """Two versions of one feed and another feed; the newest version's columns win."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    old = orders.selectExpr("CAST(o_orderkey AS STRING) AS o_orderkey", "o_orderstatus")
    versions = [("orders", 1, old), ("orders", 2, orders.select("o_orderkey", "o_totalprice")), ("events", 1, events)]
    parts = [
        column_profile(df, exact=False).select(
            F.lit(feed).alias("feed"), F.lit(n).alias("version"), "column", "dtype", "rows"
        )
        for feed, n, df in versions
    ]
    profiles = parts[0].unionAll(parts[1]).unionAll(parts[2])
    rows = profiles.groupBy("feed").agg(F.max("rows").alias("rows"))
    return catalog.feed_columns(profiles, exclude="events").join(rows, "feed")


FEEDS = {
    "orders": ("orders", {"o_orderkey": "order_id", "o_custkey": "customer_id"}),
    "items": ("lineitem", {"l_orderkey": "order_key_id", "l_partkey": "part_id", "l_suppkey": "supplier_id"}),
    "customers": ("customer", {"c_custkey": "customers_id", "c_nationkey": "nation_id"}),
    "suppliers": ("supplier", {"s_suppkey": "suppliers_id", "s_nationkey": "nation_id"}),
    "parts": ("part", {"p_partkey": "parts_id", "p_size": "size"}),
}


NAMES = sorted({n for _, columns in FEEDS.values() for n in columns.values()})
#: Every pair of names with its ratio, as brute force has it.
RATIOS = ", ".join(f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()!r}::DOUBLE)" for a in NAMES for b in NAMES)
MEASURED = union_sql([
    f"SELECT '{feed}' AS feed, '{n}' AS name, count(*) AS rows, count(DISTINCT {c}) AS u, count(*) - count({c}) AS nulls FROM {source}"
    for feed, (source, columns) in FEEDS.items() for c, n in columns.items()
])


@query(
    "foreign_key_candidates",
    f"""
    WITH m AS ({MEASURED}), r(own, other, ratio) AS (VALUES {RATIOS}),
    p AS (SELECT *, (u = rows AND nulls = 0) OR (u * 100.0 / rows >= 98.0 AND nulls * 100.0 / rows <= 5.0) AS is_key FROM m)
    SELECT p.feed, p.name AS "column", row_number() OVER w AS rank, o.feed AS other_feed, o.name AS other_column, round(r.ratio, 3) AS similarity
    FROM p JOIN r ON r.own = p.name JOIN m o ON o.name = r.other AND o.feed <> p.feed
    WHERE NOT p.is_key AND list_contains(string_split(p.name, '_'), 'id') AND r.ratio >= 0.78
    WINDOW w AS (PARTITION BY p.feed, p.name ORDER BY round(r.ratio, 3) DESC, o.feed, o.name) QUALIFY row_number() OVER w <= 5
    """,
)
def foreign_keys(spark, sf_dir):
    profiles = None
    for feed, (name, columns) in FEEDS.items():
        df = table(spark, sf_dir, name).selectExpr(*[f"{c} AS {n}" for c, n in columns.items()])
        part = column_profile(df, medians=False, samples=0, top_k=0).select(F.lit(feed).alias("feed"), "column", "is_key_candidate")
        profiles = part if profiles is None else profiles.unionAll(part)
    # Three parts of the match read the profiles; they are computed once.
    profiles = session.materialize(profiles, "profiles")
    return foreign_key_candidates(profiles, profiles.select("feed", "column"))
