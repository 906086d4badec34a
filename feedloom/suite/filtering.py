"""Row filters: conditions, folds, phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.phrases import filter_by_phrase
from feedloom.operators.predicates import Condition, keep_rows, rows_of_tenant
from feedloom.suite.profiling import EVENTS_SQL, events
from feedloom.suite.registry import query, table


@query("filter_eq_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq_ci(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return keep_rows(customer, [Condition("c_mktsegment", "eq", "Building")])


@query(
    "filter_neq_keeps_nulls",
    f"SELECT event_id, event_type FROM ({EVENTS_SQL}) WHERE event_type IS DISTINCT FROM 'click'",
)
def filter_neq(spark, sf_dir):
    chosen = events(spark, sf_dir).select("event_id", "event_type")
    return keep_rows(chosen, [Condition("event_type", "neq", "CLICK")])


@query("filter_neq_number", f"SELECT event_id, user_id, value FROM ({EVENTS_SQL}) WHERE value IS DISTINCT FROM 0.05")
def filter_neq_number(spark, sf_dir):
    return keep_rows(events(spark, sf_dir), [Condition("value", "neq", 0.05)]).select("event_id", "user_id", "value")


@query(
    "filter_range",
    "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05",
)
def filter_range(spark, sf_dir):
    tests = [
        Condition("l_quantity", "gte", 10),
        Condition("l_quantity", "lt", 20),
        Condition("l_discount", "gt", 0.05),
    ]
    return keep_rows(table(spark, sf_dir, "lineitem"), tests).select("l_orderkey", "l_quantity", "l_discount")


@query(
    "filter_datetime",
    "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-30' AND o_orderdate <= TIMESTAMP '1998-01-15'",
)
def filter_datetime(spark, sf_dir):
    tests = [Condition("o_orderdate", "gt", "1997-06-30"), Condition("o_orderdate", "lte", "1998-01-15")]
    return keep_rows(table(spark, sf_dir, "orders"), tests).select("o_orderkey")


@query("filter_contains", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the ')")
def filter_contains(spark, sf_dir):
    return keep_rows(table(spark, sf_dir, "documents"), [Condition("text", "contains", "THE ")]).select("doc_id", "n_chars")


@query("filter_contains_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)th[ae]nd')")
def filter_contains_regex(spark, sf_dir):
    test = Condition("text", "contains", "th[ae]nd", regex=True)
    return keep_rows(table(spark, sf_dir, "documents"), [test]).select("doc_id")


@query(
    "filter_left_fold",
    """
    SELECT l_orderkey, l_returnflag, l_quantity, l_tax FROM lineitem
    WHERE (l_returnflag = 'A' OR l_quantity > 45) AND l_tax < 0.03
    """,
)
def filter_left_fold(spark, sf_dir):
    tests = [
        Condition("l_returnflag", "eq", "a"),
        Condition("l_quantity", "gt", 45),
        Condition("l_tax", "lt", 0.03),
    ]
    kept = keep_rows(table(spark, sf_dir, "lineitem"), tests, ["or", "and"])
    return kept.select("l_orderkey", "l_returnflag", "l_quantity", "l_tax")


@query(
    "filter_phrase",
    """
    SELECT l_orderkey, l_quantity, l_discount FROM lineitem
    WHERE l_quantity >= 30 AND lower(l_returnflag) = 'r' AND l_discount < 0.05
    """,
)
def filter_phrase(spark, sf_dir):
    kept = filter_by_phrase(
        table(spark, sf_dir, "lineitem"),
        "Show me all rows where l_quantity is at least 30 and l_returnflag equals R and l_discount under 5%?",
    )
    return kept.select("l_orderkey", "l_quantity", "l_discount")


@query("filter_phrase_role", "SELECT o_orderkey, status FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END AS status FROM orders) WHERE status <> 'closed'")
def filter_phrase_role(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END").alias("status"),
    )
    return filter_by_phrase(named, "records that are not closed")


@query("filter_tenant", "SELECT event_id, user_id FROM events WHERE user_id = 8")
def filter_tenant(spark, sf_dir):
    return rows_of_tenant(table(spark, sf_dir, "events").select("event_id", "user_id"), 8)
