"""Profiles, leaderboards, correlations, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import drift, profile
from feedloom.suite.registry import dealt_anew, query, table, union_sql

# The given tables hold no missing values, so both sides derive some.
LINES = {
    "l_orderkey": "l_orderkey",
    "l_partkey": "nullif(l_partkey, 7)",
    "l_linenumber": "l_linenumber",
    "l_quantity": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "nullif(l_discount, CAST(0 AS DOUBLE))",
    "gross": "l_quantity * l_extendedprice",
    "l_returnflag": "nullif(l_returnflag, 'R')",
    "l_shipdate": "CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_shipdate END",
}
EVENTS = {
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "nullif(event_type, 'error')",
    "value": "CASE WHEN value > 100 THEN NULL ELSE value END",
    "ts": "ts",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


LINES_SQL = _select(LINES, "lineitem")
EVENTS_SQL = _select(EVENTS, "events")


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in LINES.items()])


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in EVENTS.items()])


def _nulls_sql(columns, source: str, extra: str = "") -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, "
            f"count(*) - count({c}) AS nulls, "
            f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 3) AS null_percent{extra.format(c=c)} "
            f"FROM ({source})"
            for c in columns
        ]
    )


@query("profile_nulls", _nulls_sql(LINES, LINES_SQL))
def profile_nulls(spark, sf_dir):
    return profile.null_profile(lines(spark, sf_dir))


@query(
    "profile_distinct",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
            f"round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 3) AS unique_percent FROM ({LINES_SQL})"
            for c in LINES
        ]
    ),
)
def profile_distinct(spark, sf_dir):
    found = profile.column_profile(lines(spark, sf_dir), medians=False, samples=0, top_k=0)
    return found.select("column", "unique_count", "unique_percent")


NUMBERS = [c for c in LINES if c not in ("l_returnflag", "l_shipdate")]


@query(
    "profile_numeric",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
            f"round(avg({c}::DOUBLE), 4) AS mean, round(median({c}::DOUBLE), 4) AS median FROM ({LINES_SQL})"
            for c in NUMBERS
        ]
    ),
)
def profile_numeric(spark, sf_dir):
    found = profile.numeric_stats(lines(spark, sf_dir))
    return found.select("column", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    "key_candidates",
    "SELECT \"column\", unique_count, (unique_count = rows AND nulls = 0 AND \"column\" <> 'o_totalprice') OR "
    "(unique_count * 100.0 / rows >= 98.0 AND nulls * 100.0 / rows <= 5.0) AS is_key_candidate FROM ("
    + union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT {c}) AS unique_count FROM orders"
            for c in ORDER_COLUMNS
        ]
    )
    + ")",
)
def key_candidates(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "orders"), medians=False, samples=0, top_k=0)
    return found.select("column", "unique_count", "is_key_candidate")


@query(
    "sample_values",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", string_agg(v::VARCHAR, ',' ORDER BY v) AS samples FROM ("
            f"SELECT DISTINCT {c} AS v FROM orders ORDER BY v LIMIT 5)"
            for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")
        ]
    ),
)
def sample_values(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    found = profile.column_profile(table(spark, sf_dir, "orders"), columns, medians=False)
    return found.select("column", F.array_join("sample_values", ",").alias("samples"))


def _top_sql(columns, source: str, k: int) -> str:
    return union_sql(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", "
            "row_number() OVER (ORDER BY count DESC, label)::INTEGER AS rank, label, count FROM ("
            f"SELECT coalesce({c}::VARCHAR, '∅') AS label, count(*) AS count FROM ({source}) GROUP BY 1)) "
            f"WHERE rank <= {k}"
            for c in columns
        ]
    )


@query("top_values", _top_sql(["event_type", "user_id"], EVENTS_SQL, 5))
def top_values(spark, sf_dir):
    return profile.top_values(events(spark, sf_dir), ["event_type", "user_id"], 5)


@query("top_n", _top_sql(["c_name", "c_mktsegment"], "SELECT * FROM customer", 10))
def top_n(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], 10)


@query(
    "headline_metrics",
    f"SELECT *, 'Most common ' || \"column\" AS description FROM ("
    + _top_sql(["category", "status"], f"SELECT event_type AS category, upper(event_type) AS status FROM ({EVENTS_SQL})", 5)
    + ")",
)
def headline_metrics(spark, sf_dir):
    named = events(spark, sf_dir).select(
        F.col("event_type").alias("category"), F.upper("event_type").alias("status"), "user_id"
    )
    return profile.headline_metrics(named)


@query(
    "group_mean_best_worst",
    """
    WITH m AS (
      SELECT o_orderpriority AS label, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
    SELECT 'o_orderpriority' AS "group", 'o_totalprice' AS value, side, rank::INTEGER AS rank, label,
           round(mean, 4) AS mean
    FROM (SELECT 'best' AS side, row_number() OVER (ORDER BY mean, label) AS rank, label, mean FROM m
          UNION ALL
          SELECT 'worst', row_number() OVER (ORDER BY mean DESC, label), label, mean FROM m)
    WHERE rank <= 5
    """,
)
def group_mean_best_worst(spark, sf_dir):
    found = profile.leaderboards(table(spark, sf_dir, "orders"), [("o_orderpriority", "o_totalprice")])
    return found.withColumn("mean", F.round("mean", 4))


@query(
    "group_mean_by_name",
    """
    WITH t AS (
      SELECT event_type AS owner_team, value AS handling_time FROM (%s)),
    m AS (SELECT owner_team AS label, avg(handling_time) AS mean FROM t
          WHERE owner_team IS NOT NULL GROUP BY 1)
    SELECT 'owner_team' AS "group", 'handling_time' AS value, side, rank::INTEGER AS rank, label,
           round(mean, 4) AS mean
    FROM (SELECT 'best' AS side, row_number() OVER (ORDER BY mean, label) AS rank, label, mean FROM m
          UNION ALL
          SELECT 'worst', row_number() OVER (ORDER BY mean DESC, label), label, mean FROM m)
    WHERE rank <= 5
    """
    % EVENTS_SQL,
)
def group_mean_by_name(spark, sf_dir):
    named = events(spark, sf_dir).select(
        F.col("event_type").alias("owner_team"), F.col("value").alias("handling_time"), "user_id"
    )
    return profile.leaderboards(named).withColumn("mean", F.round("mean", 4))


PAIRED = ("gross", "l_discount", "l_extendedprice", "l_quantity")


@query(
    "correlation_pairs",
    union_sql(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 3) AS correlation, "
            f"abs(corr({a}, {b})) >= 0.7 AS strong FROM ({LINES_SQL})"
            for i, a in enumerate(PAIRED)
            for b in PAIRED[i + 1 :]
        ]
    ),
)
def correlation_pairs(spark, sf_dir):
    return profile.correlation_pairs(lines(spark, sf_dir), PAIRED)


def iso_sql(c: str) -> str:
    return (
        f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN strftime({c}, '%f') = '000000' THEN '' ELSE '.' || strftime({c}, '%f') END"
    )


@query(
    "date_ranges",
    f"SELECT 'l_shipdate' AS \"column\", {iso_sql('min(l_shipdate)')} AS min, {iso_sql('max(l_shipdate)')} AS max "
    f"FROM ({LINES_SQL})",
)
def date_ranges(spark, sf_dir):
    return profile.date_ranges(lines(spark, sf_dir))


@query(
    "null_audit",
    "SELECT \"column\", round(nulls * 100.0::DOUBLE / rows, 2) AS null_percent FROM ("
    + _nulls_sql(LINES, LINES_SQL)
    + ") WHERE nulls * 100.0 / rows > 5",
)
def null_audit(spark, sf_dir):
    return profile.null_audit(lines(spark, sf_dir))


@query(
    "profile_approximate",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, min({c})::DOUBLE AS min, "
            f"max({c})::DOUBLE AS max FROM ({LINES_SQL})"
            for c in NUMBERS
        ]
        + [
            f"SELECT '{c}', count(*), count({c}), NULL, NULL FROM ({LINES_SQL})"
            for c in ("l_returnflag", "l_shipdate")
        ]
    ),
)
def profile_approximate(spark, sf_dir):
    found = profile.column_profile(lines(spark, sf_dir), exact=False)
    return found.select("column", "rows", "non_null", "min", "max")


@query(
    "profile_sample",
    """
    SELECT c AS "column", least(count(*), 5000)::BIGINT AS rows, true AS within, true AS repeatable
    FROM orders, (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) v(c)
    GROUP BY c
    """,
)
def profile_sample(spark, sf_dir):
    """A sample's profile: its size, values no more than the table has, and the same when it is drawn again."""
    orders = table(spark, sf_dir, "orders")
    found = profile.column_profile(orders, sample=5000).select("column", "rows", "unique_count")
    again = profile.column_profile(dealt_anew(orders, orders.count(), 5), sample=5000).select("column", F.col("unique_count").alias("again"))
    whole = profile.column_profile(orders, medians=False, samples=0, top_k=0).select("column", F.col("unique_count").alias("whole"))
    return found.join(again, "column").join(whole, "column").select(
        "column", "rows", (F.col("unique_count") <= F.col("whole")).alias("within"),
        (F.col("unique_count") == F.col("again")).alias("repeatable"),
    )


# --- drift --------------------------------------------------------------------

FILLED_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"
OPEN_SQL = (
    "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, "
    "o_orderdate FROM orders WHERE o_orderstatus = 'O'"
)


def _two_versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    new = orders.where("o_orderstatus = 'O'").select(
        "o_orderkey",
        F.col("o_custkey").cast("double").alias("o_custkey"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"),
        "o_orderdate",
    )
    return profile.light_profile(old), profile.light_profile(new)


_NEW_NULL = "round(count_if(o_orderpriority = '5-LOW') * 100.0::DOUBLE / count(*), 3)"
DRIFT_SQL = f"""
    SELECT 'o_orderdate' AS "column", 'added' AS change, NULL AS previous, 'timestamp_ntz' AS current,
           NULL::DOUBLE AS delta
    UNION ALL SELECT 'o_totalprice', 'removed', 'double', NULL, NULL
    UNION ALL SELECT 'o_custkey', 'type', 'bigint', 'double', NULL
    UNION ALL SELECT 'o_orderpriority', 'null_ratio', '0.0', p::VARCHAR, p
    FROM (SELECT {_NEW_NULL} AS p FROM orders WHERE o_orderstatus = 'O') WHERE p >= 5
    """


@query("drift_columns", DRIFT_SQL)
def drift_columns(spark, sf_dir):
    return drift.column_drift(*_two_versions(spark, sf_dir))


@query(
    "drift_rows",
    """
    SELECT 'changed' AS status, a AS previous_rows, b AS current_rows, b - a AS row_delta,
           1::BIGINT AS added, 1::BIGINT AS removed, 1::BIGINT AS type, 1::BIGINT AS null_ratio
    FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders)
    """,
)
def drift_rows(spark, sf_dir):
    return drift.drift_summary(*_two_versions(spark, sf_dir))


VERSIONS_SQL = """
    SELECT o_orderpriority AS feed, year(o_orderdate)::INTEGER AS version, count(*) AS row_count
    FROM orders GROUP BY ALL
    """


def order_versions(spark, sf_dir) -> DataFrame:
    """One feed per priority, one version per year."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("feed"), F.year("o_orderdate").alias("version")
    ).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "row_delta",
    f"""
    SELECT feed, version, row_count AS current_rows,
           lag(row_count) OVER w AS previous_rows, row_count - lag(row_count) OVER w AS row_delta,
           lag(row_count) OVER w IS NOT NULL AS has_prior
    FROM ({VERSIONS_SQL}) WINDOW w AS (PARTITION BY feed ORDER BY version)
    """,
)
def row_delta(spark, sf_dir):
    return drift.row_deltas(order_versions(spark, sf_dir))


@query(
    "column_sets",
    """
    SELECT * FROM (VALUES ('o_orderkey', 'both'), ('o_custkey', 'both'), ('o_orderpriority', 'both'),
                          ('o_totalprice', 'left'), ('o_orderdate', 'right')) AS v("column", side)
    WHERE (SELECT count(*) FROM orders) > 0
    """,
)
def column_sets(spark, sf_dir):
    return drift.column_sets(*_two_versions(spark, sf_dir))
