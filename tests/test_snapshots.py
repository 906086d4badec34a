"""Keyed merges: what readers see before, after and in the middle of one."""

import pytest
from conftest import SMALL

from feedloom.operators.steps import TransformDefinition
from feedloom.plans import jobs
from feedloom.sources import snapshots
from feedloom.sources.snapshots import merge_snapshot, read_snapshot


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_and_older_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (2, "c")], "k int, v string")
    one = merge_snapshot(first, root, ["k"], label="one", buckets=4)
    assert rows(read_snapshot(spark, root)) == [(1, "a"), (2, "c"), (None, "n")]
    second = spark.createDataFrame([(None, "m", 7), (3, "d", 8)], "k int, v string, extra int")
    two = merge_snapshot(second, root, ["k"], label="two")
    assert rows(read_snapshot(spark, root)) == [(1, "a", None), (2, "c", None), (3, "d", 8), (None, "m", 7)]
    assert rows(read_snapshot(spark, root, one)) == [(1, "a"), (2, "c"), (None, "n")]
    fewer = spark.createDataFrame([(4, "e")], "k int, v string")
    merge_snapshot(fewer, root, ["k"], gone=snapshots.F.col("k").isin(1, 2))
    assert rows(read_snapshot(spark, root).select("k", "v", "extra")) == [(3, "d", 8), (4, "e", None), (None, "m", 7)]
    assert [r["label"] for r in snapshots.snapshots(spark, root).orderBy("snapshot").collect()] == ["one", "two", ""]
    assert one < two
    with pytest.raises(ValueError, match="no such snapshot"):
        read_snapshot(spark, str(tmp_path / "none"))


def test_untouched_buckets_are_not_written_again(spark, tmp_path):
    root = str(tmp_path / "t")
    merge_snapshot(spark.range(1000).withColumnRenamed("id", "k").selectExpr("k", "'old' v"), root, ["k"], buckets=16)
    before = {r["bucket"]: r["path"] for r in snapshots._manifest(spark, root)}
    merge_snapshot(spark.createDataFrame([(5, "new")], "k long, v string"), root, ["k"])
    after = {r["bucket"]: r["path"] for r in snapshots._manifest(spark, root)}
    assert len(before) == 17 and sum(before[b] != after[b] for b in before) == 1
    table = read_snapshot(spark, root)
    assert table.count() == 1000 and table.where("v = 'new'").count() == 1


def test_empty_merges(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    merge_snapshot(frame.limit(0), root, ["k"])
    assert read_snapshot(spark, root).count() == 0
    merge_snapshot(frame, root, ["k"])
    merge_snapshot(frame.limit(0), root, ["k"])
    assert rows(read_snapshot(spark, root)) == [(1, "a")]


@pytest.mark.parametrize("stop", ["_written", "_publish"])
def test_a_run_that_stops_leaves_the_old_table_whole(spark, tmp_path, monkeypatch, stop):
    definition = TransformDefinition.from_dict(
        {
            "name": "s", "feed_identifier": "o", "target_table": "t", "incremental": True, "unique_key": ["o_orderkey"],
            "steps": [{"type": "trim", "column": "state"}],
        }
    )
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("o_orderkey", "o_orderstatus state")
    target, log = str(tmp_path / "target"), str(tmp_path / "log")
    assert jobs.run_job(orders, definition, target, log, run_id="r1", job_id="j")["rows_out"] == 1500
    changed = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "'x' state")
    with monkeypatch.context() as broken:
        def fail(*_):
            raise RuntimeError("stopped")

        broken.setattr(snapshots, stop, fail)
        run = jobs.run_job(changed, definition, target, log, run_id="r2", job_id="j")
        assert run["status"] == "failed" and "stopped" in run["message"]
    table = read_snapshot(spark, target)
    assert table.count() == 1500 and table.where("run_id <> 'r1' OR state = 'x'").isEmpty()
    run = jobs.run_job(changed, definition, target, log, run_id="r2", job_id="j")
    table = read_snapshot(spark, target)
    assert run["status"] == "success" and run["rows_out"] == changed.count()
    assert table.count() == 1500 and table.where("state = 'x'").count() == changed.count()
    run = jobs.run_job(changed.limit(1), definition, target, log, run_id="r2", job_id="j")  # the run's own rows are replaced
    assert run["rows_out"] == 1 and read_snapshot(spark, target).where("run_id = 'r2'").count() == 1
