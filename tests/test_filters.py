import fixtures
import pytest

from feedloom.operators.phrases import filter_by_phrase, parse
from feedloom.operators.predicates import Condition, fold, keep_rows


def first(df):
    return sorted(r[0] for r in df.collect())


def test_equality_phrases(spark):
    df = fixtures.frame(spark, fixtures.BALANCES)
    assert first(filter_by_phrase(df, "Show me all users where status equals active")) == [1, 3]
    # "inactive" holds "active" but is not the word.
    assert first(filter_by_phrase(df, "status equals inactive")) == [2]
    assert first(filter_by_phrase(df, "balance greater than 100")) == [1, 3]
    assert first(filter_by_phrase(df, "balance over 100 and status is not inactive")) == [1, 3]


def test_contains_and_equality(spark):
    df = fixtures.frame(spark, fixtures.PEOPLE)
    assert first(filter_by_phrase(df, "name contains smith and status equals active")) == ["Alice Smith"]


@pytest.mark.parametrize(
    "phrase,column,op,value",
    [
        ("balance at least 20", "balance", "gte", 20),
        ("balance no more than 12.5", "balance", "lte", 12.5),
        ("balance under 5%", "balance", "lt", 0.05),
        ("balance is -3", "balance", "eq", -3),
        ("status = 'Not Open'", "status", "eq", "Not Open"),
        ('status == "this and that"', "status", "eq", "this and that"),
        ("status does not equal closed", "status", "neq", "closed"),
        ("resolved ones", "status", "eq", "resolved"),
        ("user id is 7", "user_id", "eq", 7),
    ],
)
def test_phrase_parts(spark, phrase, column, op, value):
    (condition,), _ = parse(phrase, fixtures.frame(spark, fixtures.BALANCES))
    assert (condition.column, condition.op, condition.value) == (column, op, value)


def test_operator_words_are_whole_words(spark):
    df = spark.createDataFrame([("discovered",), ("notable",)], "topic string")
    (condition,), _ = parse("topic notable", df)
    assert (condition.op, condition.value) == ("eq", "notable")
    (condition,), _ = parse("topic discovered", df)
    assert (condition.op, condition.value) == ("eq", "discovered")


def test_phrases_that_say_nothing(spark):
    df = fixtures.frame(spark, fixtures.BALANCES)
    for phrase in ("show me all rows", "weather is nice", "status equals", "balance over lots"):
        with pytest.raises(ValueError):
            filter_by_phrase(df, phrase)


def test_fold_has_no_precedence(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 1), (1, 1, 1)], "a int, b int, c int")
    tests = [Condition("a", "eq", 1), Condition("b", "eq", 1), Condition("c", "eq", 1)]
    assert keep_rows(df, tests, ["or", "and"]).count() == 2
    with pytest.raises(ValueError):
        fold(df, [])


def test_missing_values(spark):
    df = spark.createDataFrame([("A", 1.0), (None, None), ("b", float("nan"))], "s string, v double")
    assert keep_rows(df, [Condition("s", "neq", "a")]).count() == 2
    assert keep_rows(df, [Condition("s", "eq", "a")]).count() == 1
    assert keep_rows(df, [Condition("v", "neq", 1.0)]).count() == 2
    assert keep_rows(df, [Condition("v", "gt", 0)]).count() == 1
    assert keep_rows(df, [Condition("s", "contains", "B")]).count() == 1


def test_contains_is_literal_unless_asked(spark):
    df = spark.createDataFrame([("a.c",), ("abc",)], "s string")
    assert keep_rows(df, [Condition("s", "contains", "a.c")]).count() == 1
    assert keep_rows(df, [Condition("s", "contains", "a.c", regex=True)]).count() == 2


def test_datetime_operand(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01'), (timestamp_ntz'2024-03-01') AS t(at)")
    assert keep_rows(df, [Condition("at", "gt", "2024-02-01")]).count() == 1
    assert keep_rows(df, [Condition("at", "gt", "whenever")]).count() == 0
    assert keep_rows(df, [Condition("at", "neq", "whenever")]).count() == 2
    assert filter_by_phrase(df, "at over 2024-02-01").count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 2 AS twice", "'x' AS s").write.parquet(path)
    kept = keep_rows(spark.read.parquet(path), [Condition("twice", "gt", 5)]).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(twice,5)" in plan and "s:string" not in plan
