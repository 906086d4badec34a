"""Cleaning steps, one query per step type."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators.steps import dry_run, frame_diff, run_steps
from feedloom.suite.profiling import EVENTS_SQL, events
from feedloom.suite.registry import query, table


@query("step_rename", "SELECT c_custkey AS customer_id, c_name, c_acctbal FROM customer")
def step_rename(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    steps = [
        {"type": "rename", "column": "c_custkey", "new_name": "customer_id"},
        {"type": "rename", "column": "absent", "new_name": "ignored"},
    ]
    return run_steps(df, steps)


@query("step_rename_mapping", "SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal FROM customer")
def step_rename_mapping(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return run_steps(df, [{"type": "rename", "mapping": {"c_custkey": "customer_id", "c_name": "full_name"}}])


@query(
    "step_cast",
    """
    SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::DOUBLE AS o_custkey,
           trunc(o_totalprice)::BIGINT AS o_totalprice, TRY_CAST(o_orderstatus AS BIGINT) AS o_orderstatus
    FROM orders
    """,
)
def step_cast(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    steps = [
        {"type": "cast", "column": "o_orderkey", "dtype": "str"},
        {"type": "cast", "column": "o_custkey", "dtype": "float64"},
        {"type": "cast", "column": "o_totalprice", "dtype": "int64"},
        {"type": "cast", "column": "o_orderstatus", "dtype": "int64", "on_error": "null"},
    ]
    return run_steps(df, steps)


PADDED = "concat(chr(9), ' ', p_name, '  ', chr(10))"


@query("step_trim", "SELECT p_partkey, p_name AS both_sides, concat(p_name, '  ', chr(10)) AS left_side, concat(chr(9), ' ', p_name) AS right_side, nullif(p_brand, 'Brand#4') AS brand FROM part")
def step_trim(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{PADDED} AS both_sides", f"{PADDED} AS left_side", f"{PADDED} AS right_side",
        "concat(' ', nullif(p_brand, 'Brand#4')) AS brand",
    )
    steps = [
        {"type": "trim", "column": "both_sides"},
        {"type": "trim", "column": "left_side", "method": "left"},
        {"type": "trim", "column": "right_side", "method": "right"},
        {"type": "trim", "column": "brand"},
    ]
    return run_steps(df, steps)


@query(
    "step_parse_date",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS plain,
           CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS coerced,
           CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS kept
    FROM orders
    """,
)
def step_parse_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "date_format(o_orderdate, 'dd/MM/yyyy HH:mm:ss') AS plain",
        "CASE WHEN o_orderstatus <> 'P' THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'unknown' END AS coerced",
        "CASE WHEN o_orderstatus <> 'P' THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'unknown' END AS kept",
    )
    steps = [
        {"type": "parse_date", "column": "plain", "format": "%d/%m/%Y %H:%M:%S", "errors": "raise"},
        {"type": "parse_date", "column": "coerced", "format": "%d/%m/%Y"},
        {"type": "parse_date", "column": "kept", "format": "%d/%m/%Y", "errors": "ignore"},
    ]
    parsed = run_steps(df, steps)
    return parsed.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("plain", "coerced")}
    )


@query(
    "step_fillna",
    f"SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1) AS value FROM ({EVENTS_SQL})",
)
def step_fillna(spark, sf_dir):
    df = events(spark, sf_dir).select(
        "event_id", "event_type", F.coalesce("value", F.lit(float("nan"))).alias("value")
    )
    steps = [
        {"type": "fillna", "column": "event_type", "value": "unknown"},
        {"type": "fillna", "column": "value", "value": -1},
    ]
    return run_steps(df, steps)


@query(
    "step_map_values",
    """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'build' WHEN 'MACHINERY' THEN 'machine' ELSE c_mktsegment END AS segment,
           CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS nation
    FROM customer
    """,
)
def step_map_values(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    steps = [
        {"type": "map_values", "column": "segment", "mapping": {"BUILDING": "build", "MACHINERY": "machine"}},
        {"type": "map_values", "column": "nation", "mapping": {"1": "one", "2": "two"}, "default": "other"},
    ]
    return run_steps(df, steps)


@query(
    "step_split_column",
    """
    SELECT p_partkey, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS thing, NULL::VARCHAR AS extra,
           p_brand AS a, CASE WHEN p_type <> 'SMALL' THEN p_type END AS b
    FROM part
    """,
)
def step_split_column(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name",
        "CASE WHEN p_type <> 'SMALL' THEN concat(p_brand, '||', p_type, '||rest') ELSE p_brand END AS pair",
    )
    steps = [
        {"type": "split_column", "column": "p_name", "into": ["color", "thing", "extra"], "delimiter": " ", "drop_original": True},
        {"type": "split_column", "column": "pair", "into": ["a", "b"], "delimiter": "||", "drop_original": True},
    ]
    return run_steps(df, steps)


@query(
    "step_merge_columns",
    "SELECT c_custkey, c_custkey::VARCHAR || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || '-' || c_name AS label FROM customer",
)
def step_merge_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_custkey AS number", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_name"
    )
    step = {
        "type": "merge_columns", "columns": ["number", "segment", "c_name"], "into": "label",
        "separator": "-", "drop_sources": True,
    }
    return run_steps(df, [step])


@query(
    "step_deduplicate",
    """
    SELECT user_id, event_type, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM (%s)) WHERE r = 1
    """
    % EVENTS_SQL,
)
def step_deduplicate(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    step = {"type": "deduplicate", "subset": ["user_id", "event_type"], "keep": "last", "order_by": ["ts"]}
    return run_steps(df, [step, {"type": "drop", "columns": ["ts"]}])


@query(
    "step_join",
    "SELECT o_orderkey, o_custkey AS c_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def step_join(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS c_custkey")
    step = {
        "type": "join", "right_dataset": "customers", "left_on": ["c_custkey"], "right_on": ["c_custkey"],
        "how": "left", "select": ["c_custkey", "c_name", "c_acctbal"],
    }
    return run_steps(df, [step], {"customers": table(spark, sf_dir, "customer")})


@query(
    "step_filter",
    "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25 AND NOT contains(lower(l_returnflag), 'a')",
)
def step_filter(spark, sf_dir):
    steps = [
        {"type": "filter", "column": "l_quantity", "op": "gt", "value": 25},
        {"type": "filter", "column": "l_returnflag", "op": "contains", "value": "a", "negate": True},
        {"type": "select", "columns": ["l_orderkey", "l_quantity", "l_returnflag"]},
    ]
    return run_steps(table(spark, sf_dir, "lineitem"), steps)


@query("step_select", "SELECT s_suppkey, s_name FROM supplier")
def step_select(spark, sf_dir):
    return run_steps(table(spark, sf_dir, "supplier"), [{"type": "select", "columns": ["s_suppkey", "s_name"]}])


@query("step_drop", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def step_drop(spark, sf_dir):
    return run_steps(table(spark, sf_dir, "supplier"), [{"type": "drop", "columns": ["s_acctbal", "absent"]}])


@query("step_string_clean", "SELECT c_custkey, lower(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
def step_string_clean(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('  ', c_name, chr(9)) AS c_name", "concat(c_mktsegment, ' ') AS c_mktsegment"
    )
    steps = [
        {"type": "string_clean", "columns": ["c_name"], "operations": ["strip", "lower"]},
        {"type": "string_clean", "columns": ["c_mktsegment"], "operations": ["strip", "upper"]},
    ]
    return run_steps(df, steps)


@query(
    "cleaned_orders",
    """
    SELECT id, status, priority, day FROM (
      SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'p' END AS status,
             upper(split_part(o_orderpriority, '-', 2)) AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day
      FROM orders)
    WHERE status <> 'finished'
    """,
)
def cleaned_orders(spark, sf_dir):
    """Several steps in a row; they compile to one scan and one projection."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat(' ', lower(o_orderstatus), ' ') AS status", "o_orderpriority",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
    )
    steps = [
        {"type": "rename", "column": "o_orderkey", "new_name": "id"},
        {"type": "trim", "column": "status"},
        {"type": "map_values", "column": "status", "mapping": {"f": "finished", "o": "open"}},
        {"type": "split_column", "column": "o_orderpriority", "into": ["level", "priority"], "delimiter": "-", "drop_original": True},
        {"type": "string_clean", "columns": ["priority"], "operations": ["upper"]},
        {"type": "filter", "column": "status", "op": "neq", "value": "finished"},
        {"type": "drop", "columns": ["level"]},
    ]
    return run_steps(df, steps)


@query(
    "frame_diff",
    """
    SELECT (SELECT count(*) FROM orders) AS rows_before,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows_after,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') - (SELECT count(*) FROM orders) AS row_delta,
           'id' AS columns_added, 'o_orderdate,o_orderkey,o_orderpriority' AS columns_removed,
           'o_custkey: bigint -> string' AS type_changes
    """,
)
def frame_diff_query(spark, sf_dir):
    before = table(spark, sf_dir, "orders")
    steps = [
        {"type": "rename", "column": "o_orderkey", "new_name": "id"},
        {"type": "cast", "column": "o_custkey", "dtype": "str"},
        {"type": "filter", "column": "o_orderstatus", "op": "eq", "value": "F"},
        {"type": "drop", "columns": ["o_orderdate", "o_orderpriority"]},
    ]
    found = frame_diff(before, run_steps(before, steps))
    lists = ("columns_added", "columns_removed", "type_changes")
    return found.select(
        "rows_before", "rows_after", "row_delta", *[F.array_join(c, ",").alias(c) for c in lists]
    )


@query(
    "dry_run",
    """
    SELECT least(500, count(*)) AS rows_before, least(500, count(*)) AS rows_after, 0::BIGINT AS row_delta,
           'status' AS columns_added, 'o_orderpriority,o_orderstatus' AS columns_removed,
           'o_totalprice: double -> string' AS type_changes
    FROM orders
    """,
)
def dry_run_query(spark, sf_dir):
    steps = [
        {"type": "rename", "column": "o_orderstatus", "new_name": "status"},
        {"type": "cast", "column": "o_totalprice", "dtype": "str"},
        {"type": "drop", "columns": ["o_orderpriority"]},
    ]
    found = dry_run(table(spark, sf_dir, "orders"), steps)
    lists = ("columns_added", "columns_removed", "type_changes")
    return found.select(
        "rows_before", "rows_after", "row_delta", *[F.array_join(c, ",").alias(c) for c in lists]
    )
