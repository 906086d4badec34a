"""No registered query may multiply tables or gather a group in one task."""

import pytest
from conftest import SMALL
from pyspark.sql.classic.dataframe import DataFrame

from feedloom.suite import QUERIES, registry

RANKED = (
    "dedup_first", "dedup_last", "latest_version", "chunk_ids", "dq_rule_status", "recent_questions",
    "context_pack", "knn_exact", "top_values", "group_mean_best_worst", "upsert_last_wins", "foreign_key_candidates",
)


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", RANKED)
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


@pytest.mark.parametrize("name,least", [("table_fingerprint", 7), ("ingested_feed", 3), ("profile_sample", 5)])
def test_tables_in_another_order_get_parts_by_their_rows(spark, monkeypatch, name, least):
    parts, repartition = [], DataFrame.repartition
    monkeypatch.setattr(registry, "PART_ROWS", 100)
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *keys: (parts.append(n), repartition(df, n, *keys))[1])
    QUERIES[name](spark, SMALL)
    assert max(p for p in parts if isinstance(p, int)) > least
    assert registry.dealt_anew(spark.range(5), 5, least).rdd.getNumPartitions() == least
