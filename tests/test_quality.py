import fixtures

from feedloom.operators import quality
from feedloom.operators.profile import column_profile


def outcome(df):
    return {r["rule_id"]: r for r in df.collect()}


def test_rules_of_a_profile(spark):
    rules = outcome(quality.generate_rules(column_profile(fixtures.frame(spark, fixtures.TICKETS))))
    assert rules["row_count_min"]["threshold"] == 2.0
    assert rules["null_ratio_max:status"]["threshold"] == 10.0
    assert rules["uniqueness:ticket_id"]["severity"] == "error"
    assert "uniqueness:status" not in rules
    assert quality.generate_rules(column_profile(spark.createDataFrame([], "a int"))).count() == 1


def test_manual_rules_survive(spark):
    profile = column_profile(fixtures.frame(spark, fixtures.TICKETS))
    manual = spark.createDataFrame(
        [("m1", "status", "null_ratio_max", 0.0, "error", "mine", True), ("old", "x", "uniqueness", 0.0, "warn", "", False)],
        quality.RULE_SCHEMA,
    )
    ids = set(outcome(quality.sync_rules(manual, profile)))
    assert "m1" in ids and "old" not in ids and "row_count_min" in ids


def rule(kind, column, threshold, severity="warn"):
    return (f"{kind}:{column}", column, kind, threshold, severity, "", False)


def test_every_outcome(spark):
    df = spark.createDataFrame(
        [(1, None, "2024-01-01"), (1, None, "soon"), (None, "x", "2024-01-03"), (4, "y", None)], "k int, s string, d string"
    )
    rules = spark.createDataFrame(
        [
            rule("row_count_min", None, 4.0), rule("row_count_min", "k", 5.0),
            rule("null_ratio_max", "s", 50.0), rule("null_ratio_max", "k", 20.0, "error"),
            rule("uniqueness", "k", 0.0, "error"), rule("uniqueness", "s", 2.0),
            rule("datetime_parseable", "d", None), rule("null_ratio_max", "absent", 1.0), rule("odd", "k", 1.0),
        ],
        quality.RULE_SCHEMA,
    )
    found = quality.evaluate_rules(df, rules)
    status = {k: (r["status"], r["actual"]) for k, r in outcome(found).items()}
    assert status["null_ratio_max:s"] == ("pass", 50.0) and status["null_ratio_max:k"] == ("fail", 25.0)
    # A missing key counts as a duplicate.
    assert status["uniqueness:k"] == ("fail", 2.0) and status["uniqueness:s"] == ("pass", 2.0)
    assert status["datetime_parseable:d"] == ("fail", 33.3)
    assert status["null_ratio_max:absent"][0] == "skip" and status["odd:k"][0] == "skip"
    row = quality.summarize(found).first()
    assert row["status"] == "fail" and row["total"] == 9
    assert [r["rule_id"] for r in quality.error_failures(found).collect()] == ["null_ratio_max:k", "uniqueness:k"]
    details = outcome(found)["uniqueness:k"]["details"]
    assert details["distinct"] == 2.0 and details["total"] == 4.0


def test_empty_table_skips_column_rules(spark):
    df = spark.createDataFrame([], "k int, d string")
    rules = spark.createDataFrame(
        [rule("row_count_min", None, 1.0), rule("null_ratio_max", "k", 1.0), rule("uniqueness", "k", 0.0), rule("datetime_parseable", "d", None)],
        quality.RULE_SCHEMA,
    )
    status = {k: r["status"] for k, r in outcome(quality.evaluate_rules(df, rules)).items()}
    assert list(status.values()).count("skip") == 3 and status["row_count_min:None"] == "fail"


def test_sampled_dates(spark):
    df = spark.createDataFrame([("2024-01-01",)] * 20 + [(None,)] * 5, "d string")
    rules = spark.createDataFrame([rule("datetime_parseable", "d", None)], quality.RULE_SCHEMA)
    row = quality.evaluate_rules(df, rules, sample=10).first()
    assert row["status"] == "pass" and row["details"]["checked"] == 10.0


def test_latest_result_and_pending(spark):
    rules = spark.createDataFrame([("a",), ("b",)], "rule_id string")
    results = spark.createDataFrame(
        [("a", "fail", "2024-01-01", 1, None), ("a", "pass", "2024-01-02", 2, None)],
        "rule_id string, status string, created_at string, result_id int, details string",
    )
    status = quality.rule_status(rules, results)
    assert {r["rule_id"]: r["status"] for r in status.collect()} == {"a": "pass", "b": "pending"}
    row = quality.feed_status(status).first()
    assert (row["status"], row["total"], row["passed"]) == ("pass", 2, 2)
    assert quality.feed_status(status.where("false")).first()["status"] == "pending"


def test_freshness(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-30 12:00:00' AS ts")
    assert quality.freshness(df, "ts", "2024-01-31 00:00:00", "1 day").first()["status"] == "pass"
    assert quality.freshness(df, "ts", "2024-02-02 00:00:00", "1 day").first()["status"] == "fail"
    assert quality.freshness(df.limit(0), "ts", "2024-02-02 00:00:00").first()["status"] == "fail"
