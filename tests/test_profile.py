import math

import fixtures
import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from feedloom.operators import drift, profile


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_summary_of_counts(spark):
    rows = by_column(profile.column_profile(fixtures.frame(spark, fixtures.INCIDENT_COUNTS)))
    assert rows["Category"]["rows"] == 4
    assert tuple(rows["Category"]["top_values"][0]) == ("Login", 2)
    assert rows["Count"]["min"] == 1 and rows["Count"]["max"] == 5 and rows["Count"]["median"] == 2.5


def test_numeric_only_has_no_top_values(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "Count bigint")
    row = profile.column_profile(df).first()
    assert (row["min"], row["max"], row["mean"], row["top_values"]) == (1, 5, 3, None)
    assert profile.headline_metrics(df).count() == 0
    assert profile.leaderboards(df).count() == 0


def test_leaderboard_best_and_worst(spark):
    rows = profile.leaderboards(fixtures.frame(spark, fixtures.RESOLVERS)).collect()
    first = {r["side"]: (r["label"], r["mean"]) for r in rows if r["rank"] == 1}
    assert first == {"best": ("Priya", 5.0), "worst": ("Alex", 15.0)}


def test_nulls_and_nan_are_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, "z"), (float("nan"), None)], "a double, b string")
    rows = by_column(profile.column_profile(df))
    assert (rows["a"]["nulls"], rows["a"]["non_null"], rows["a"]["unique_count"]) == (2, 2, 2)
    assert rows["a"]["max"] == 2.0 and not math.isnan(rows["a"]["mean"])
    assert by_column(profile.null_profile(df))["a"]["nulls"] == 2
    assert ("∅", 1) in [tuple(t) for t in rows["b"]["top_values"]]


def test_empty_and_all_null(spark):
    empty = by_column(profile.column_profile(spark.createDataFrame([], "a bigint, b string")))
    assert empty["a"]["rows"] == 0 and empty["a"]["null_percent"] == 0 and not empty["a"]["is_key_candidate"]
    nulls = by_column(profile.column_profile(spark.createDataFrame([(None, None)], "a double, b string")))
    assert nulls["a"]["null_percent"] == 100.0 and nulls["a"]["median"] is None


def test_types_survive_in_values(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, CAST(1.5 AS FLOAT), CAST(2.50 AS DECIMAL(5,2)), date'2024-01-01', X'00FF', array(1, 2), "
        "0.0D), (false, CAST(1.5 AS FLOAT), CAST(3.50 AS DECIMAL(5,2)), date'2024-01-02', X'00FE', array(1, 2), -0.0D) "
        "AS t(flag, f, d, day, raw, list, zero)"
    )
    rows = by_column(profile.column_profile(df))
    assert [rows[c]["unique_count"] for c in df.columns] == [2, 1, 2, 2, 2, 1, 1]
    assert rows["flag"]["mean"] == 0.5 and rows["d"]["median"] == 3.0 and rows["f"]["max"] == 1.5
    assert rows["day"]["logical_type"] == "datetime" and rows["day"]["sample_values"] == ["2024-01-01", "2024-01-02"]


def test_key_candidates(spark):
    rows = by_column(profile.column_profile(fixtures.frame(spark, fixtures.TICKETS)))
    assert rows["ticket_id"]["is_key_candidate"] and not rows["status"]["is_key_candidate"]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [1.0, 1.0, 1.0, 9.0], [5.0, 5.0, 7.0, 7.0], list(map(float, range(501)))])
def test_median_paths_agree(spark, values):
    df = spark.createDataFrame([(0, v, 1 + i % 3) for i, v in enumerate(values)], "k int, number double, n bigint")
    small = profile.exact_median(df, "k", bound=10**6).first()["median"]
    large = profile.exact_median(df, "k", bound=1).first()["median"]
    assert small == large


def test_median_paths_agree_on_orders(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    counted = profile.value_frequencies(orders).where("number IS NOT NULL").select("ordinal", "number", "n")
    a = sorted(profile.exact_median(counted, "ordinal", bound=10**6).collect())
    b = sorted(profile.exact_median(counted, "ordinal", bound=1).collect())
    assert a == b


def test_partition_count_does_not_matter(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_quantity")
    one, many = (sorted(profile.column_profile(items.repartition(n)).collect()) for n in (1, 8))
    assert [r.asDict() for r in one] == [r.asDict() for r in many]


def test_approximate_is_close(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    exact, rough = by_column(profile.column_profile(orders)), by_column(profile.column_profile(orders, exact=False))
    for name, row in exact.items():
        assert abs(rough[name]["unique_count"] - row["unique_count"]) <= 0.05 * row["unique_count"]
        assert (rough[name]["min"], rough[name]["max"]) == (row["min"], row["max"])
    tops = {t["label"]: t["count"] for t in rough["o_orderstatus"]["top_values"]}
    assert tops == {t["label"]: t["count"] for t in exact["o_orderstatus"]["top_values"]}


def test_sample_is_repeatable(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    picks = [
        {r[0] for r in profile.sample_rows(orders.repartition(n), 100).select("o_orderkey").collect()} for n in (1, 7)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 100


def test_ties_go_to_the_smaller_label(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [r["label"] for r in profile.top_values(df, k=3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_audits_read_the_data(spark):
    """The flagged columns, correlations and date ranges come from the rows."""
    df = spark.range(20).select(
        F.when(F.col("id") > 3, F.col("id")).alias("gap"), F.col("id"), (F.col("id") * 2).alias("twice"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT))").alias("day"),
    )
    assert [r["column"] for r in profile.null_audit(df).collect()] == ["gap"]
    pairs = {(r["col_a"], r["col_b"]): r["correlation"] for r in profile.correlation_pairs(df).collect()}
    assert pairs[("id", "twice")] == 1.0
    assert tuple(profile.date_ranges(df).first()) == ("day", "2024-01-01T00:00:00", "2024-01-20T00:00:00")


def test_median_of_many_keys_and_shared_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v), int(n)) for k, v, n in zip(rng.integers(0, 60, 4000), rng.integers(-9, 9, 4000), rng.integers(1, 4, 4000))]
    rows += [(99, None, 5)]
    df = spark.createDataFrame(rows, "k int, number double, n bigint").repartition(5)
    got = {r["k"]: r["median"] for r in profile.exact_median(df, "k", bound=100).collect()}
    spread = {}
    for k, v, n in rows[:-1]:
        spread.setdefault(k, []).extend([v] * n)
    assert got == {k: float(np.median(v)) for k, v in spread.items()}
    assert profile.exact_median(df.limit(0), "k").count() == 0


def test_correlations_of_many_columns(spark):
    """Over pairwise complete rows; columns that do not vary have none, and one scan serves all pairs."""
    rng = np.random.default_rng(11)
    made = pd.DataFrame(rng.normal(size=(700, 9)), columns=[f"x{i}" for i in range(9)])
    made["x1"] = made["x0"] * -2 + rng.normal(size=700) * 0.1
    made["x2"] += 1e9
    made["x3"] = 0.1
    for i in (0, 1, 4, 5):
        made.loc[rng.random(700) < 0.35, f"x{i}"] = None
    made["x6"] = np.where(made["x5"].notna(), 0.3, made["x6"])  # does not vary beside x5
    made["x7"] = None
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else float(v) for v in r) for r in made.itertuples(index=False)],
        ", ".join(f"x{i} double" for i in range(9)),
    ).repartition(7)
    want = made.astype(float).corr()
    rows = profile.correlation_pairs(df).collect()
    many = {(r["col_a"], r["col_b"]): r["correlation"] for r in rows}
    expected = {
        (a, b) for a in want for b in want
        if a < b and "x3" not in (a, b) and "x7" not in (a, b) and {a, b} != {"x5", "x6"}
    }
    assert set(many) == expected
    assert all(abs(v - want.loc[k]) < 6e-4 for k, v in many.items())
    assert [(r["col_a"], r["col_b"]) for r in rows if r["strong"]] == [("x0", "x1")]
    assert profile.correlation_pairs(df.limit(0)).count() == 0
    wide = df.select(*[(F.col(f"x{i % 9}") * (i + 1)).alias(f"c{i:03d}") for i in range(120)])
    plan = profile.correlation_pairs(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_drift_between_versions(spark):
    old = spark.createDataFrame([(1, "a", 1.0)] * 10, "id bigint, gone string, v double")
    new = spark.createDataFrame([("1", None, 5)] * 9 + [("2", 3.0, 5)], "id string, v double, fresh int")
    before, after = profile.column_profile(old), profile.column_profile(new)
    moves = {(r["column"], r["change"]): r["delta"] for r in drift.column_drift(before, after).collect()}
    assert moves == {("gone", "removed"): None, ("fresh", "added"): None, ("id", "type"): None, ("v", "null_ratio"): 90.0}
    assert drift.drift_summary(None, after).first()["status"] == "baseline"
    assert drift.drift_summary(after, after).first()["status"] == "no_change"
    row = drift.drift_summary(before, after).first()
    assert (row["status"], row["row_delta"]) == ("changed", 0)
