"""Data-quality rules on orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import session

from feedloom.operators import quality
from feedloom.operators.profile import column_profile
from feedloom.suite.registry import query, table, union_sql

COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

# The later delivery: fewer rows, one column mostly empty, a repeated key, dates as text.
DIRTY = {
    "o_orderkey": "CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_orderkey END",
    "o_custkey": "o_custkey",
    "o_orderstatus": "nullif(o_orderstatus, 'O')",
    "o_totalprice": "o_totalprice",
    "o_orderpriority": "o_orderpriority",
}
_TEXT_DATE_SPARK = "CASE WHEN o_totalprice > 400000 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS o_orderdate"
_KEEP = "o_orderstatus <> 'P' OR o_totalprice > 100000"


def dirty_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(_KEEP)
    return orders.selectExpr(*[f"{e} AS {n}" for n, e in DIRTY.items()], _TEXT_DATE_SPARK)


DIRTY_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items())
    + ", CASE WHEN o_totalprice > 400000 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate"
    + f" FROM orders WHERE {_KEEP}"
)


def rules(spark, sf_dir):
    return quality.generate_rules(column_profile(table(spark, sf_dir, "orders"), medians=False, samples=0, top_k=0))


_RULES_SQL = union_sql(
    [
        """
        SELECT 'row_count_min' AS rule_id, NULL AS "column", 'row_count_min' AS rule_type,
               greatest(1, floor(count(*) * 0.9::DOUBLE)) AS threshold, 'warn' AS severity FROM orders
        """
    ]
    + [
        f"""
        SELECT 'null_ratio_max:{c}', '{c}', 'null_ratio_max',
               least(100.0::DOUBLE, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 3) + 10), 'warn' FROM orders
        """
        for c in COLUMNS
    ]
    + [
        f"""
        SELECT 'uniqueness:{c}', '{c}', 'uniqueness', 0::DOUBLE, 'error' FROM orders
        HAVING count(DISTINCT {c}) * 100.0 / count(*) >= 98 AND (count(*) - count({c})) * 100.0 / count(*) <= 5
        """
        for c in COLUMNS
    ]
    + ["SELECT 'datetime_parseable:o_orderdate', 'o_orderdate', 'datetime_parseable', NULL, 'warn'"]
)


@query("dq_rules", _RULES_SQL)
def dq_rules(spark, sf_dir):
    return rules(spark, sf_dir).select("rule_id", "column", "rule_type", "threshold", "severity")


_FACTS_SQL = union_sql(
    [f"SELECT NULL AS col, count(*) AS total, NULL::BIGINT AS nulls, NULL::BIGINT AS dist, NULL::BIGINT AS bad FROM ({DIRTY_SQL})"]
    + [
        f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), "
        + (f"count(*) FILTER ({c} IS NOT NULL AND try_cast({c} AS TIMESTAMP) IS NULL)" if c == "o_orderdate" else "NULL")
        + f" FROM ({DIRTY_SQL})"
        for c in COLUMNS
    ]
)
RESULTS_SQL = f"""
    SELECT rule_id, severity, actual,
           CASE WHEN rule_type = 'row_count_min' THEN CASE WHEN actual >= threshold THEN 'pass' ELSE 'fail' END
                WHEN rule_type = 'datetime_parseable' THEN CASE WHEN actual <= 10 THEN 'pass' ELSE 'fail' END
                ELSE CASE WHEN actual <= threshold THEN 'pass' ELSE 'fail' END END AS status
    FROM (SELECT r.*, CASE rule_type
                 WHEN 'row_count_min' THEN total::DOUBLE
                 WHEN 'null_ratio_max' THEN round(nulls * 100.0::DOUBLE / total, 2)
                 WHEN 'uniqueness' THEN (total - dist)::DOUBLE
                 ELSE round(bad * 100.0::DOUBLE / (total - nulls), 1) END AS actual
          FROM ({_RULES_SQL}) r JOIN ({_FACTS_SQL}) f ON r."column" IS NOT DISTINCT FROM f.col)
    """


def results(spark, sf_dir):
    return quality.evaluate_rules(dirty_orders(spark, sf_dir), rules(spark, sf_dir))


@query("dq_results", RESULTS_SQL)
def dq_results(spark, sf_dir):
    return results(spark, sf_dir).select("rule_id", "severity", "actual", "status")


@query(
    "dq_summary",
    f"""
    SELECT CASE WHEN count_if(status = 'fail') = 0 THEN 'pass' ELSE 'fail' END AS status,
           count_if(status = 'pass')::BIGINT AS passed, count_if(status = 'fail')::BIGINT AS failed,
           count_if(status = 'skip')::BIGINT AS skipped, count(*) AS total
    FROM ({RESULTS_SQL})
    """,
)
def dq_summary(spark, sf_dir):
    return quality.summarize(results(spark, sf_dir))


@query(
    "dq_error_failures",
    f"SELECT rule_id, actual FROM ({RESULTS_SQL}) WHERE status = 'fail' AND severity = 'error' ORDER BY rule_id LIMIT 5",
)
def dq_error_failures(spark, sf_dir):
    return quality.error_failures(results(spark, sf_dir)).select("rule_id", "actual")


# A result log made of events: the event type is the rule, its value decides.
STATUS_SQL = """
    CASE WHEN value > 100 THEN 'fail' WHEN value < 1 THEN 'skip' ELSE 'pass' END
    """
RULE_STATUS_SQL = f"""
    SELECT r.rule_id, coalesce(l.status, 'pending') AS status
    FROM (SELECT DISTINCT event_type AS rule_id FROM events
          UNION ALL SELECT DISTINCT c_mktsegment FROM customer) r
    LEFT JOIN (SELECT event_type AS rule_id, {STATUS_SQL} AS status FROM events
               QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1) l
    ON r.rule_id = l.rule_id
    """


def _statuses(spark, sf_dir):
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    known = events.select(F.col("event_type").alias("rule_id")).distinct()
    unseen = customer.select(F.col("c_mktsegment").alias("rule_id")).distinct()
    log = events.select(
        F.col("event_type").alias("rule_id"),
        F.expr(STATUS_SQL).alias("status"),
        F.lit(None).cast("string").alias("details"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("result_id"),
    )
    return quality.rule_status(known.union(unseen), log)


@query("dq_rule_status", RULE_STATUS_SQL)
def dq_rule_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("rule_id", "status")


@query(
    "dq_feed_status",
    f"""
    SELECT CASE WHEN count_if(status = 'fail') > 0 THEN 'fail' WHEN count(*) > 0 THEN 'pass' ELSE 'pending' END AS status,
           count(*) AS total, (count(*) - count_if(status IN ('fail', 'skip')))::BIGINT AS passed,
           count_if(status = 'fail')::BIGINT AS failed, count_if(status = 'skip')::BIGINT AS skipped
    FROM ({RULE_STATUS_SQL})
    """,
)
def dq_feed_status(spark, sf_dir):
    return quality.feed_status(_statuses(spark, sf_dir))


@query(
    "dq_freshness",
    """
    SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest,
           CASE WHEN max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR THEN 'pass' ELSE 'fail' END AS status
    FROM events
    """,
)
def dq_freshness(spark, sf_dir):
    found = quality.freshness(table(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", "12 hours")
    return found.select(F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "status")


@query(
    "dq_logged_status",
    f"""
    SELECT CASE WHEN count_if(status = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) + 1 AS total,
           (count(*) + 1 - count_if(status IN ('fail', 'skip')))::BIGINT AS passed, count_if(status = 'fail')::BIGINT AS failed,
           count_if(status = 'skip')::BIGINT AS skipped
    FROM ({RESULTS_SQL})
    """,
)
def dq_logged_status(spark, sf_dir):
    """Rules run over two versions of a table into one log; a manual rule added later is pending."""
    path = session.scratch_path(spark, "results")
    found = results(spark, sf_dir)
    old = found.withColumn("created_at", F.col("created_at") - F.expr("interval 1 day")).withColumn("status", F.lit("skip"))
    quality.log_results(old, path)
    quality.log_results(found, path)
    logged = quality.read_results(spark, path)
    rules = found.select(*[f.split()[0] for f in quality.RULE_SCHEMA.split(", ")])
    manual = rules.limit(1).withColumn("rule_id", F.lit("manual:1")).withColumn("is_manual", F.lit(True))
    return quality.feed_status(quality.rule_status(rules.unionByName(manual), logged))


@query(
    "dq_error_total",
    f"SELECT count(*) AS failed_in_all, least(count(*), 1) AS shown FROM ({RESULTS_SQL}) WHERE status = 'fail' AND severity = 'error' HAVING count(*) > 0",
)
def dq_error_total(spark, sf_dir):
    failed = quality.error_failures(results(spark, sf_dir), 1)
    return failed.groupBy("failed_in_all").agg(F.count(F.lit(1)).alias("shown"))
