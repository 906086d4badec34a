import fixtures
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedloom.operators import joins, latest
from feedloom.operators.steps import TransformDefinition, dry_run, frame_diff, run_steps, spark_date_pattern, step_from


def one(df):
    return [tuple(r) for r in df.collect()]


def test_dirty_tickets(spark):
    steps = [
        {"type": "rename", "column": "ticket_id", "new_name": "id"},
        {"type": "trim", "column": "status"},
        {"type": "map_values", "column": "status", "mapping": {"open": "OPEN", "closed": "CLOSED"}},
        {"type": "deduplicate", "subset": ["id", "status", "agent_id"], "order_by": ["row_id"]},
        {"type": "drop", "columns": ["row_id"]},
    ]
    out = run_steps(fixtures.frame(spark, fixtures.DIRTY), steps)
    assert sorted(one(out)) == [(1, "OPEN", 10), (2, "CLOSED", 20)] and out.columns[0] == "id"


def test_trim_keeps_null_and_knows_unicode_space(spark):
    df = spark.createDataFrame([(None,), ("  a b \x1f",)], "s string")
    assert one(run_steps(df, [{"type": "trim", "column": "s"}])) == [(None,), ("a b",)]


def test_cast_raises_or_nulls(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    with pytest.raises(PySparkException):
        run_steps(df, [{"type": "cast", "column": "s", "dtype": "int64"}]).collect()
    out = run_steps(df, [{"type": "cast", "column": "s", "dtype": "int64", "on_error": "null"}])
    assert one(out) == [(1,), (None,), (None,)]


def test_parse_date_modes(spark):
    df = spark.createDataFrame([("03/02/2024",), ("soon",), (None,)], "d string")
    step = {"type": "parse_date", "column": "d", "format": "%d/%m/%Y"}
    assert [r[0] and r[0].isoformat() for r in run_steps(df, [step]).collect()] == ["2024-02-03T00:00:00", None, None]
    assert one(run_steps(df, [{**step, "errors": "ignore"}])) == [("2024-02-03 00:00:00",), ("soon",), (None,)]
    with pytest.raises(PySparkException):
        run_steps(df, [{**step, "errors": "raise"}]).collect()
    assert spark_date_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_fillna_fills_nan_too(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double")
    assert one(run_steps(df, [{"type": "fillna", "column": "v", "value": 0}])) == [(0.0,), (0.0,), (2.0,)]


def test_map_values_inline_and_joined_agree(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,), ("zz",)], "s string")
    small = {"1": "one", "2": "two"}
    big = {**small, **{f"k{i}": "x" for i in range(300)}}
    for default in (None, "other"):
        out = [
            sorted(one(run_steps(df, [{"type": "map_values", "column": "s", "mapping": m, "default": default}])), key=str)
            for m in (small, big)
        ]
        assert out[0] == out[1]
    numbers = spark.createDataFrame([(1,), (5,)], "n bigint")
    assert one(run_steps(numbers, [{"type": "map_values", "column": "n", "mapping": {"1": 10}}])) == [(10,), (5,)]


def test_split_is_literal_and_null_safe(spark):
    df = spark.createDataFrame([("a||b||c",), ("a",), (None,)], "s string")
    step = {"type": "split_column", "column": "s", "into": ["x", "y"], "delimiter": "||", "drop_original": True}
    assert one(run_steps(df, [step])) == [("a", "b"), ("a", None), (None, None)]


def test_merge_keeps_separator_for_null(spark):
    df = spark.createDataFrame([(None, "y"), ("x", "y")], "a string, b string")
    step = {"type": "merge_columns", "columns": ["a", "b"], "into": "m", "drop_sources": True}
    assert one(run_steps(df, [step])) == [(" y",), ("x y",)]


def test_deduplicate_modes_with_null_keys(spark):
    rows = [(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)]
    df = spark.createDataFrame(rows, "k string, n int")
    assert sorted(one(latest.deduplicate(df, ["k"], "first", ["n"])), key=str) == sorted([(None, 1), ("a", 3), ("b", 4)], key=str)
    assert sorted(one(latest.deduplicate(df, ["k"], "last", ["n"])), key=str) == sorted([(None, 2), ("a", 3), ("b", 5)], key=str)
    assert one(latest.deduplicate(df, ["k"], "any")) == [("a", 3)]


@pytest.mark.parametrize("how,count", [("left", 3), ("inner", 2), ("right", 4), ("outer", 5)])
def test_join_kinds_match_null_keys(spark, how, count):
    left = spark.createDataFrame([(1, "l1"), (None, "l0"), (9, "l9")], "k int, v string")
    right = spark.createDataFrame([(1, "r1"), (None, "r0"), (7, "r7"), (8, "r8")], "k int, v string")
    out = joins.join_tables(left, right, ["k"], how=how)
    assert out.columns == ["k", "v", "v_right"] and out.count() == count
    assert out.where("v = 'l0' AND v_right = 'r0'").count() == 1
    if how in ("right", "outer"):
        assert out.where("k = 7 AND v IS NULL AND v_right = 'r7'").count() == 1
    plain = joins.join_tables(left, right, ["k"], how="inner", null_safe=False)
    assert plain.count() == 1


def test_outer_join_with_a_hot_key_keeps_every_row(spark):
    left = spark.range(400).select(F.when(F.col("id") < 200, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("b"))
    out = joins.join_tables(left, right, ["k"], how="outer")
    # 200 hot rows + keys 200..299 matched, 100 left alone, 199 right alone.
    assert out.count() == 200 + 100 + 100 + 199
    assert out.where("a IS NULL").count() == 199 and out.where("b IS NULL").count() == 100


def test_join_names(spark):
    left = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    right = spark.createDataFrame([(1, 5, 6)], "b int, c int, d int")
    out = joins.join_tables(left, right, ["a"], ["b"], suffixes=("_l", "_r"))
    assert out.columns == ["a", "b_l", "c_l", "b_r", "c_r", "d"] and one(out) == [(1, 2, 3, 1, 5, 6)]
    with pytest.raises(ValueError, match="join keys"):
        joins.join_tables(left, right, ["a"], ["b"], select=["d"])


def test_step_definitions_are_strict():
    with pytest.raises(ValueError, match="unknown step type"):
        step_from({"type": "explode"})
    with pytest.raises(ValueError, match="unknown fields"):
        step_from({"type": "trim", "column": "a", "side": "left"})
    with pytest.raises(ValueError, match="missing fields"):
        step_from({"type": "trim"})
    for bad in (
        {"type": "split_column", "column": "a", "into": ["x"], "delimiter": ","},
        {"type": "merge_columns", "columns": ["a"], "into": "x"},
        {"type": "deduplicate", "subset": []},
        {"type": "join", "right_dataset": "r", "left_on": [], "right_on": []},
    ):
        with pytest.raises(ValueError):
            step_from(bad)
    definition = TransformDefinition.from_dict(
        {"name": "n", "feed_identifier": "f", "target_table": "t", "steps": [{"type": "drop", "columns": ["a"]}]}
    )
    assert definition.load_strategy == "append" and definition.steps[0].columns == ["a"]


def test_custom_step_and_missing_join_input(spark):
    df = spark.range(3)
    assert run_steps(df, [{"type": "custom", "function": lambda d: d.where("id > 0")}]).count() == 2
    with pytest.raises(ValueError, match="not in the context"):
        run_steps(df, [{"type": "join", "right_dataset": "r", "left_on": ["id"], "right_on": ["id"]}])


def test_diff_and_dry_run(spark):
    df = spark.range(1000).withColumn("x", F.lit("a"))
    row = dry_run(df, [{"type": "filter", "column": "id", "op": "gte", "value": 0}, {"type": "drop", "columns": ["x"]}]).first()
    assert (row["rows_before"], row["rows_after"], row["columns_removed"]) == (500, 500, ["x"])
    assert len(row["preview_before"]) == 5
    row = frame_diff(df, df.limit(0)).first()
    assert (row["row_delta"], row["preview_after"]) == (-1000, [])


def test_adjacent_steps_stay_one_projection(spark):
    df = spark.range(10).withColumn("s", F.lit(" a "))
    steps = [
        {"type": "trim", "column": "s"},
        {"type": "string_clean", "columns": ["s"], "operations": ["upper"]},
        {"type": "rename", "column": "s", "new_name": "t"},
        {"type": "filter", "column": "id", "op": "gt", "value": 3},
    ]
    plan = run_steps(df, steps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project") == 1 and "Exchange" not in plan and "BatchEvalPython" not in plan
