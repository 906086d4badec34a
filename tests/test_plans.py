import fixtures
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from feedloom.operators.quality import generate_rules
from feedloom.operators.profile import column_profile
from feedloom.operators.steps import TransformDefinition
from feedloom.plans import analysis, jobs, questions, sqlguard
from feedloom.sources.catalog import catalog_columns
from feedloom.sources.snapshots import read_snapshot, snapshots
from feedloom.streaming import refresh


def ask(spark, df, *asked):
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "n int, question string")
    return [r["answer"] for r in questions.answer(frame, df).orderBy("n").collect()]


def test_direct_answers(spark):
    df = fixtures.frame(spark, fixtures.RESOLVERS)
    most, fast, slow, none = ask(
        spark, df, "Who handled the most tickets?", "Which resolver is the fastest?", "Which assigned_to is slowest?", "What is new?"
    )
    assert most == "Alex handled the most tickets (2). Next: Priya (1), Sam (1)."
    assert fast == "Priya is the fastest for Resolution Time Hours (5.00). Next: Sam (7.00), Alex (15.00)."
    assert slow.startswith("Alex is the slowest for") and none is None
    assert ask(spark, df, "who has the fewest tickets?")[0].startswith("Sam handled the fewest tickets (1).")


def test_answers_without_text_or_numbers(spark):
    assert ask(spark, spark.createDataFrame([(1,)], "n int"), "most n?") == [None]


def test_intent_and_flags(spark):
    rows = [("Any duplicates?",), ("count rows",), ("Show me all",), ("hello",), (None,)]
    df = spark.createDataFrame(rows, "q string")
    got = [tuple(r) for r in df.select(questions.intent(F.col("q")), questions.needs_data(F.col("q")), questions.wants_list(F.col("q"))).collect()]
    assert got == [
        ("duplicates", True, False), ("count", True, False), ("list", True, True), ("unknown", False, False), ("unknown", False, False)
    ]


GOOD = [
    "SELECT ticket_id FROM tickets WHERE status = 'open'",
    "WITH t AS (SELECT status, count(*) AS n FROM tickets GROUP BY status) SELECT * FROM t ORDER BY n DESC LIMIT 5;",
    "SELECT status FROM tickets WHERE ticket_id IN (SELECT max(ticket_id) FROM tickets) UNION SELECT 'x'",
    "SELECT a.status FROM tickets a JOIN Tickets b ON a.ticket_id = b.ticket_id",
    "SELECT status, rank() OVER (ORDER BY status) FROM tickets",
]
BAD = [
    "DROP TABLE tickets", "CREATE TABLE x AS SELECT 1", "INSERT INTO tickets VALUES (1, 'a', 'b')", "SET a = 1",
    "DELETE FROM tickets", "UPDATE tickets SET status = 'x'", "SELECT 1; SELECT 2", "SELECT * FROM secrets",
    "SELECT * FROM parquet.`/etc`", "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets",
    "SELECT * FROM tickets WHERE ticket_id IN (SELECT id FROM secrets)", "SELECT reflect('java.lang.System', 'exit', 1)",
    "SELECT TRANSFORM(status) USING 'cat' FROM tickets", "CACHE TABLE tickets", "SHOW TABLES", "SELECT nope FROM tickets",
    "EXPLAIN SELECT 1", "not sql", "SELECT (SELECT max(x) FROM secrets) FROM tickets",
]


@pytest.mark.parametrize("sql", GOOD)
def test_queries_pass_the_guard(spark, sql):
    sqlguard.guarded_query(spark, sql, {"tickets": fixtures.frame(spark, fixtures.TICKETS)}).collect()


@pytest.mark.parametrize("sql", BAD)
def test_everything_else_is_rejected(spark, sql):
    with pytest.raises(sqlguard.SqlRejected):
        sqlguard.guarded_query(spark, sql, {"tickets": fixtures.frame(spark, fixtures.TICKETS)})


def test_row_cap_is_exact(spark):
    tables = {"tickets": fixtures.frame(spark, fixtures.TICKETS)}
    result = sqlguard.run_query(spark, "SELECT * FROM tickets ORDER BY ticket_id", tables, limit=3)
    assert (result.row_count, result.truncated, result.columns[0]) == (3, False, "ticket_id")
    assert sqlguard.run_query(spark, "SELECT * FROM tickets", tables, limit=2).truncated


def test_plan_follows_the_schema(spark):
    df = fixtures.frame(spark, fixtures.RESOLVERS).withColumn("day", F.lit("2024-01-01").cast("date"))
    kinds = [t.type for t in analysis.derive_plan(df, has_prior=True, schemas=["main"])]
    assert kinds == ["count_by"] * 3 + ["avg_by", "null_audit", "drift_check", "row_delta", "date_range", "schema_inventory"]
    short = analysis.derive_plan(df, limit=2)
    assert [t.column for t in short] == ["Assigned_To", "Ticket_ID"]
    assert len(analysis.derive_plan(df, limit=12, schemas=[f"s{i}" for i in range(30)])) == 12


def test_plan_runs_every_task_type(spark):
    df = fixtures.frame(spark, fixtures.RESOLVERS).withColumn("half", F.col("Resolution_Time_Hours") / 2)
    tasks = [analysis.Task("count_by", column="Assigned_To"), analysis.Task("avg_by", group="Assigned_To", value="Resolution_Time_Hours")]
    tasks += [analysis.Task(k) for k in ("null_audit", "drift_check", "row_delta", "date_range", "correlation_hint")]
    tasks += [analysis.Task("top_n", column="Ticket_ID", n=2), analysis.Task("schema_inventory", schema="main")]
    listed = catalog_columns({"tickets": df})
    rows = analysis.run_plan(df, tasks, previous=df.limit(3).drop("half"), catalog=listed).collect()
    by_type = {}
    for r in rows:
        by_type.setdefault(r["type"], []).append(r)
    assert [r["value"] for r in by_type["count_by"] if r["label"] == "Alex"] == [2.0]
    assert {r["label"]: r["value"] for r in by_type["row_delta"]} == {"previous_rows": 3, "current_rows": 4, "row_delta": 1}
    assert [(r["subject"], r["label"]) for r in by_type["drift_check"]] == [("half", "added")]
    assert by_type["correlation_hint"][0]["value"] == 1.0 and len(by_type["top_n"]) == 2
    assert by_type["schema_inventory"][0]["label"] == "tickets" and "null_audit" not in by_type
    with pytest.raises(ValueError, match="unknown task types"):
        analysis.run_plan(df, [analysis.Task("guess")])


def definition(**changes):
    base = {
        "name": "clean", "feed_identifier": "tickets", "target_table": "tickets_clean",
        "steps": [
            {"type": "rename", "column": "ticket_id", "new_name": "id"},
            {"type": "trim", "column": "status"},
            {"type": "deduplicate", "subset": ["id", "status", "agent_id"], "order_by": ["row_id"]},
        ],
    }
    return TransformDefinition.from_dict({**base, **changes})


def test_job_runs_the_steps(spark, tmp_path):
    df = fixtures.frame(spark, fixtures.DIRTY)
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    rules = generate_rules(column_profile(df.withColumnRenamed("ticket_id", "id")))
    run = jobs.run_job(df, definition(), target, log, run_id="r1", job_id="j", rules=rules)
    assert (run["status"], run["rows_in"], run["rows_out"]) == ("success", 3, 2), run["message"]
    assert run["warnings"] == ["columns_removed: ticket_id"] and run["dq_status"] == "pass"
    # The same run again replaces its own output, another run appends.
    jobs.run_job(df, definition(), target, log, run_id="r1", job_id="j")
    jobs.run_job(df, definition(), target, log, run_id="r2", job_id="j")
    assert spark.read.parquet(target).count() == 4
    jobs.run_job(df, definition(load_strategy="replace"), target, log, run_id="r3", job_id="j")
    assert spark.read.parquet(target).count() == 2
    failed = jobs.run_job(df, definition(steps=[{"type": "trim", "column": "absent"}]), target, log, run_id="r4", job_id="j")
    assert failed["status"] == "failed" and spark.read.parquet(target).count() == 2
    runs = jobs.read_runs(spark, log)
    assert runs.count() == 4 and jobs.last_runs(runs).first()["run_id"] == "r4"


def test_run_stats_without_runs(spark):
    listed = spark.createDataFrame(
        [("j1", "u", True, None, "2024-01-01"), ("j2", "u", False, "0 6 * * *", "2024-01-02")],
        "job_id string, user_id string, is_active boolean, schedule string, created_at string",
    )
    none = spark.createDataFrame([], jobs.RUN_SCHEMA)
    row = jobs.run_stats(listed, none).first()
    assert (row["jobs_total"], row["jobs_active"], row["jobs_scheduled"], row["runs_total"], row["last_status"]) == (2, 1, 1, 0, None)
    assert [r["job_id"] for r in jobs.list_jobs(listed, none).collect()] == ["j2", "j1"]


def test_refresh_is_incremental_and_repeatable(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    events.where("event_id < 400").repartition(3).write.mode("append").parquet(folder)
    refresh.refresh_feed(spark, folder, events.schema, target, mark, files_per_batch=1)
    assert refresh.read_refreshed(spark, target).count() == events.where("event_id < 400").count()
    refresh.refresh_feed(spark, folder, events.schema, target, mark)
    events.where("event_id >= 400").write.mode("append").parquet(folder)
    refresh.refresh_feed(spark, folder, events.schema, target, mark)
    out = refresh.read_refreshed(spark, target)
    assert out.count() == events.count() and out.exceptAll(events).isEmpty()
    # A batch that is written again replaces itself.
    refresh._write_batch(events.limit(10), 0, str(tmp_path / "again"))
    refresh._write_batch(events.limit(10), 0, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 10


def test_merged_profile_equals_batch_profile(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "event_type", "value")
    folder = str(tmp_path / "in")
    for test in ("event_id < 100", "event_id >= 100 AND event_id < 700", "event_id >= 700"):
        events.where(test).write.mode("append").parquet(folder)
        merged = refresh.refresh_profile(spark, folder, events.schema, str(tmp_path / "state"), str(tmp_path / "mark"))
    exact = {r["column"]: r for r in column_profile(events).collect()}
    for r in merged.collect():
        want = exact[r["column"]]
        assert [r[c] for c in ("rows", "nulls", "min", "max")] == [want[c] for c in ("rows", "nulls", "min", "max")]
        assert abs(r["approx_unique"] - want["unique_count"]) <= max(1, 0.05 * want["unique_count"])


def test_merged_sketches_of_hard_columns(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'v' || id END AS word", "CAST(NULL AS DOUBLE) AS none",
        "repeat('x', 300) || id % 2 AS long", "id % 101 AS n",
    )
    folder = str(tmp_path / "in")
    for half in ("n < 50", "n >= 50"):
        rows.where(half).write.mode("append").parquet(folder)
        merged = refresh.refresh_profile(spark, folder, rows.schema, str(tmp_path / "state"), str(tmp_path / "mark"))
    found = {r["column"]: r for r in merged.collect()}
    hot = found["word"]["top_values"][0]
    assert hot["label"] == "hot" and 0 <= hot["count"] - 6667 <= 20
    assert found["none"]["approx_median"] is None and found["none"]["top_values"] == []
    assert abs(found["n"]["approx_median"] - 50) <= 2
    assert sorted(v["count"] for v in found["long"]["top_values"]) == [10_000, 10_000]
    assert all(len(v["label"]) == refresh.LONGEST_LABEL for v in found["long"]["top_values"])


def test_keyed_refresh_compacts_and_repeats_nothing(spark, tmp_path):
    folder, root, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (1, "c")], "k int, v string")
    second = spark.createDataFrame([(2, "a"), (None, "m")], "k int, v string")
    for batch in (first, second):
        batch.write.mode("append").parquet(folder)
        for _ in range(2):
            refresh.refresh_keyed(spark, folder, batch.schema, root, mark, ["k"])
    refresh.merge_batch(first, 0, root, ["k"])
    assert {tuple(r) for r in read_snapshot(spark, root).collect()} == {(1, "c"), (2, "a"), (None, "m")}
    assert [r["label"] for r in snapshots(spark, root).orderBy("snapshot").collect()] == ["batch 0", "batch 1"]
