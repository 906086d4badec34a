"""Guarded SQL, question routing, direct answers, analysis plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import session
from feedloom.plans import analysis, questions, sqlguard
from feedloom.sources.catalog import catalog_columns
from feedloom.suite.profiling import EVENTS_SQL, events, iso_sql
from feedloom.suite.registry import query, table

GUARDED = {
    "guarded_sql_count": "SELECT count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT'",
    "guarded_sql_topk": (
        "SELECT l_returnflag, count(*) AS items FROM lineitem GROUP BY l_returnflag ORDER BY items DESC, l_returnflag LIMIT 5"
    ),
    "guarded_sql_average": (
        "WITH p AS (SELECT o_orderpriority, o_totalprice FROM orders) "
        "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS average FROM p GROUP BY o_orderpriority ORDER BY average"
    ),
    "guarded_sql_duplicates": (
        "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem "
        "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
    ),
}


def _guarded(text: str):
    def run(spark, sf_dir):
        names = ("orders", "lineitem")
        return sqlguard.guarded_query(spark, text, {n: table(spark, sf_dir, n) for n in names})

    return run


for _name, _text in GUARDED.items():
    query(_name, _text)(_guarded(_text))


INTENT_SQL = """
    CASE WHEN contains(lower(text), 'dup') THEN 'duplicates' WHEN contains(lower(text), 'count') THEN 'count'
         WHEN contains(lower(text), 'list') OR contains(lower(text), 'show') THEN 'list' ELSE 'unknown' END
    """


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(
    "question_routing",
    f"""
    SELECT conv_id, turn, {INTENT_SQL} AS intent,
           ({INTENT_SQL}) <> 'unknown' OR {_any_sql(questions.DATA_WORDS)} AS needs_data,
           {_any_sql(questions.LIST_WORDS)} AS wants_list
    FROM conversations
    """,
)
def question_routing(spark, sf_dir):
    q = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", questions.intent(q).alias("intent"), questions.needs_data(q).alias("needs_data"),
        questions.wants_list(q).alias("wants_list"),
    )


def tickets(spark, sf_dir):
    """Orders seen as tickets: who holds them and how long they take."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS assigned_to", "o_totalprice AS resolution_hours", "o_orderstatus AS stage"
    )


_ASK = {
    "user": "Who handled the most tickets?",
    "assistant": "Which resolver is the slowest?",
    "system": "Who has the fewest tickets?",
}


@query(
    "direct_answers",
    """
    WITH top AS (SELECT o_orderpriority AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r
                 FROM orders GROUP BY 1),
    slow AS (SELECT o_orderpriority AS label, avg(o_totalprice) AS m, row_number() OVER (ORDER BY avg(o_totalprice) DESC, o_orderpriority) AS r
             FROM orders GROUP BY 1),
    a AS (
      SELECT 'user' AS role, (SELECT label || ' handled the most tickets (' || n || ').' FROM top WHERE r = 1) || ' Next: '
        || (SELECT string_agg(label || ' (' || n || ')', ', ' ORDER BY r) FROM top WHERE r IN (2, 3)) || '.' AS answer
      UNION ALL
      SELECT 'system', (SELECT label || ' handled the fewest tickets (' || n || ').' FROM top WHERE r = 5) || ' Next: '
        || (SELECT string_agg(label || ' (' || n || ')', ', ' ORDER BY r DESC) FROM top WHERE r IN (3, 4)) || '.'
      UNION ALL
      SELECT 'assistant', (SELECT label || ' is the slowest for resolution hours (' || printf('%.2f', round(m, 2)) || ').' FROM slow WHERE r = 1)
        || ' Next: ' || (SELECT string_agg(label || ' (' || printf('%.2f', round(m, 2)) || ')', ', ' ORDER BY r) FROM slow WHERE r IN (2, 3)) || '.')
    SELECT conv_id, turn, answer FROM conversations JOIN a USING (role)
    """,
)
def direct_answers(spark, sf_dir):
    asked = F.when(F.lit(False), "")
    for role, text in _ASK.items():
        asked = asked.when(F.col("role") == role, text)
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("question"))
    return questions.answer(talk, tickets(spark, sf_dir)).drop("question")


PLAN_SQL = f"""
    WITH e AS (SELECT event_type AS owner, value AS handling_time, ts, user_id FROM ({EVENTS_SQL})),
    c AS (SELECT coalesce(owner, '∅') AS label, count(*) AS n FROM e GROUP BY 1),
    d AS (SELECT {iso_sql('ts').replace("T%H", " %H")} AS label, count(*) AS n FROM e GROUP BY 1),
    m AS (SELECT owner AS label, avg(handling_time) AS mean FROM e WHERE owner IS NOT NULL GROUP BY 1)
    SELECT 0 AS task, 'count_by' AS type, 'owner' AS subject, label, n::DOUBLE AS value,
           (row_number() OVER (ORDER BY n DESC, label))::VARCHAR AS note FROM c
    UNION ALL
    SELECT 2, 'avg_by', 'handling_time by owner', label, round(mean, 4), side || ' ' || r FROM (
      SELECT 'best' AS side, label, mean, row_number() OVER (ORDER BY mean, label) AS r FROM m
      UNION ALL SELECT 'worst', label, mean, row_number() OVER (ORDER BY mean DESC, label) FROM m) WHERE r <= 5
    UNION ALL
    SELECT 3, 'null_audit', 'owner', 'null_percent', round((count(*) - count(owner)) * 100.0::DOUBLE / count(*), 2), NULL FROM e
      HAVING (count(*) - count(owner)) * 100.0 / count(*) > 5
    UNION ALL
    SELECT 3, 'null_audit', 'handling_time', 'null_percent', round((count(*) - count(handling_time)) * 100.0::DOUBLE / count(*), 2), NULL FROM e
      HAVING (count(*) - count(handling_time)) * 100.0 / count(*) > 5
    UNION ALL SELECT 4, 'row_delta', NULL, 'previous_rows', count_if(user_id > 25)::DOUBLE, 'changed' FROM e
    UNION ALL SELECT 4, 'row_delta', NULL, 'current_rows', count(*)::DOUBLE, 'changed' FROM e
    UNION ALL SELECT 4, 'row_delta', NULL, 'row_delta', (count(*) - count_if(user_id > 25))::DOUBLE, 'changed' FROM e
    UNION ALL SELECT 5, 'date_range', 'ts', 'min', NULL, {iso_sql('min(ts)')} FROM e
    UNION ALL SELECT 5, 'date_range', 'ts', 'max', NULL, {iso_sql('max(ts)')} FROM e
    """


@query("analysis_plan", PLAN_SQL)
def analysis_plan(spark, sf_dir):
    df = events(spark, sf_dir).selectExpr("event_type AS owner", "value AS handling_time", "ts", "user_id")
    tasks = [
        analysis.Task("count_by", column="owner"),
        analysis.Task("correlation_hint"),
        analysis.Task("avg_by", group="owner", value="handling_time"),
        analysis.Task("null_audit"),
        analysis.Task("row_delta"),
        analysis.Task("date_range"),
    ]
    found = analysis.run_plan(df, tasks, previous=df.where("user_id > 25"))
    return found.withColumn("value", F.round("value", 4))


@query(
    "analysis_plan_derived",
    """
    WITH a AS (SELECT o_orderpriority AS label, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    s AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT 0 AS task, 'count_by' AS type, 'assigned_to' AS subject, label, n::DOUBLE AS value,
           (row_number() OVER (ORDER BY n DESC, label))::VARCHAR AS note FROM a
    UNION ALL
    SELECT 1, 'count_by', 'stage', label, n::DOUBLE, (row_number() OVER (ORDER BY n DESC, label))::VARCHAR FROM s
    UNION ALL
    SELECT 2, 'avg_by', 'resolution_hours by assigned_to', label, round(mean, 4), side || ' ' || r FROM (
      SELECT 'best' AS side, label, mean, row_number() OVER (ORDER BY mean, label) AS r FROM a
      UNION ALL SELECT 'worst', label, mean, row_number() OVER (ORDER BY mean DESC, label) FROM a) WHERE r <= 5
    UNION ALL
    SELECT 4, 'schema_inventory', 'main', 'tickets', 3, 'assigned_to, resolution_hours, stage' FROM orders HAVING count(*) > 0
    """,
)
def analysis_plan_derived(spark, sf_dir):
    df = tickets(spark, sf_dir)
    tasks = analysis.derive_plan(df, schemas=["main"])
    found = analysis.run_plan(df, tasks, catalog=catalog_columns({"tickets": df}))
    return found.withColumn("value", F.round("value", 4))


@query(
    "direct_answers_many_values",
    """
    WITH n AS (SELECT CAST(c_nationkey AS VARCHAR) AS label, count(*) AS n FROM customer GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS most, row_number() OVER (ORDER BY n, label DESC) AS least FROM n),
    a AS (
      SELECT 0 AS k, (SELECT label || ' handled the most tickets (' || n || ').' FROM r WHERE most = 1) || ' Next: '
        || (SELECT string_agg(label || ' (' || n || ')', ', ' ORDER BY most) FROM r WHERE most IN (2, 3)) || '.' AS answer
      UNION ALL
      SELECT 1, (SELECT label || ' handled the fewest tickets (' || n || ').' FROM r WHERE least = 1) || ' Next: '
        || (SELECT string_agg(label || ' (' || n || ')', ', ' ORDER BY least) FROM r WHERE least IN (2, 3)) || '.')
    SELECT conv_id, turn, answer FROM conversations JOIN a ON k = turn % 2
    """,
)
def direct_answers_many_values(spark, sf_dir):
    """The text of every turn with a question added, about a column of 25 values."""
    added = F.when(F.col("turn") % 2 == 0, " Who has the most tickets?").otherwise(" Who has the fewest tickets?")
    talk = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.regexp_replace("text", r"(?i)\b(most|highest|largest|top|greatest|fewest|least|lowest|smallest)\b", ""), added).alias("question")
    )
    held = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("assigned_to"))
    return questions.answer(talk, held).drop("question")


@query(
    "capped_sql",
    """
    SELECT 10 AS asked, least(count(*), 10)::BIGINT AS rows, count(*) > 10 AS truncated FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 25, least(count(*), 25)::BIGINT, count(*) > 25 FROM nation
    """,
)
def capped_sql(spark, sf_dir):
    """Row caps with an exact flag: more rows than asked for, and just as many."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "nation")}
    parts = []
    for text, limit in (("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'", 10), ("SELECT * FROM nation", 25)):
        found = sqlguard.run_query(spark, text, tables, limit)
        parts.append((limit, found.row_count, found.truncated))
    return session.literal_rows(spark, parts, "asked int, rows bigint, truncated boolean")


@query(
    "analysis_plan_wide",
    """
    SELECT 'count_by' AS type, 9 AS tasks, 6 AS left_out FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'avg_by', 1, 13 FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'null_audit', 1, 0 FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'date_range', 1, 0 FROM orders HAVING count(*) > 0
    """,
)
def analysis_plan_wide(spark, sf_dir):
    """Sixteen countable columns: the structural tasks keep their slots, and what is cut is known."""
    orders = table(spark, sf_dir, "orders")
    texts = [F.col("o_orderpriority").alias(f"owner_{i}") for i in range(14)]
    wide = orders.select(*texts, "o_orderdate", F.col("o_totalprice").alias("resolution_hours"))
    plan, cut = analysis.derive_plan(wide), analysis.left_out(wide)
    ran = analysis.run_plan(wide, plan).select("task", "type").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("ran"))
    kinds = [(k, sum(t.type == k for t in plan), sum(t.type == k for t in cut)) for k in ("count_by", "avg_by", "null_audit", "date_range")]
    known = session.literal_rows(spark, kinds, "type string, tasks int, left_out int")
    # a task without rows (no column above the null limit) still stands in the plan
    return known.join(ran, "type", "left").where("ran IS NULL OR ran = tasks").select("type", "tasks", "left_out")
