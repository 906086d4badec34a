"""Jobs: run a cleaning definition on a feed version, and report on runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.numbers import iso, seconds_between
from feedloom.operators.latest import last_per_group
from feedloom.operators.quality import error_failures, evaluate_rules, summarize
from feedloom.operators.steps import TransformDefinition, run_steps
from feedloom.sources.snapshots import merge_snapshot, read_snapshot
from feedloom.types import col

RUN_SCHEMA = (
    "run_id string, job_id string, user_id string, status string, started_at timestamp, "
    "finished_at timestamp, rows_in bigint, rows_out bigint, warnings array<string>, "
    "dq_status string, dq_failures array<string>, message string"
)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def run_job(
    source: DataFrame,
    definition: TransformDefinition,
    target: str,
    log: str,
    *,
    run_id: str,
    job_id: str,
    user_id: str = "default",
    context: Mapping[str, DataFrame] | None = None,
    rules: DataFrame | None = None,
) -> dict[str, object]:
    """Read, clean, write, check, and log one run; the run row is returned.

    Output is partitioned by run id and a run replaces only its own partition
    (``append``) or the whole table (``replace``), so repeating a failed run
    never duplicates rows. An incremental definition merges its rows into the table by ``unique_key``:
    rows of earlier runs with a key of this run go, and of this run's rows with one key the last by
    all other columns in order stays. Such a table is read by ``read_snapshot``: a run that fails or stops
    at any point leaves the last whole snapshot in place, and earlier snapshots stay readable. Counts are read from the stored files. A failure
    becomes a run row with status ``failed``; so does a column called ``run_id``, which is reserved.
    """
    spark, started = source.sparkSession, _now()
    run: dict[str, object] = {
        "run_id": run_id, "job_id": job_id, "user_id": user_id, "status": "failed",
        "started_at": started, "finished_at": None, "rows_in": 0, "rows_out": 0,
        "warnings": [], "dq_status": None, "dq_failures": [], "message": None,
    }
    try:
        if definition.load_strategy not in ("append", "replace"):
            raise ValueError(f"unknown load strategy {definition.load_strategy!r}")
        cleaned = run_steps(source, definition.steps, context)
        if "run_id" in cleaned.columns:
            raise ValueError("the column name 'run_id' is reserved for the run that wrote a row")
        if definition.incremental and not definition.unique_key:
            raise ValueError("an incremental definition needs a unique_key")
        removed = sorted(set(source.columns) - set(cleaned.columns))
        if definition.incremental:
            order = [c for c in cleaned.columns if c not in definition.unique_key] or list(definition.unique_key)
            own = F.col("run_id") == run_id  # what an earlier attempt of this run wrote
            merge_snapshot(
                cleaned.withColumn("run_id", F.lit(run_id)), target, definition.unique_key, order, label=run_id, gone=own
            )
            stored = read_snapshot(spark, target).where(own).select(*map(col, cleaned.columns))
        else:
            writer = cleaned.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id")
            mode = "static" if definition.load_strategy == "replace" else "dynamic"
            writer.option("partitionOverwriteMode", mode).parquet(target)
            stored = spark.read.schema(cleaned.schema).parquet(f"{target}/run_id={run_id}")
        run["rows_in"], run["rows_out"] = source.count(), stored.count()
        run["warnings"] = [f"columns_removed: {', '.join(removed)}"] if removed else []
        if rules is not None:
            results = evaluate_rules(stored, rules).persist()
            run["dq_status"] = summarize(results).first()["status"]
            run["dq_failures"] = [r["rule_id"] for r in error_failures(results, None).collect()]
            results.unpersist()
        run["status"] = "success"
        run["message"] = f"processed rows_in={run['rows_in']} rows_out={run['rows_out']}"
    except Exception as problem:  # noqa: BLE001 - every failure is logged as a run
        run["message"] = f"job failed: {problem}"
        run["warnings"] = [f"error: {str(problem).splitlines()[0]}"]
    run["finished_at"] = _now()
    spark.createDataFrame([run], RUN_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{log}/{run_id}")
    return run


def read_runs(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", True).json(log)


def last_runs(runs: DataFrame, key: str = "job_id") -> DataFrame:
    """The newest run per job or user."""
    return last_per_group(runs, [key], ["started_at", "run_id"])


def list_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs, newest first, each with its last run if it has one."""
    newest = last_runs(runs).select(
        "job_id",
        F.col("run_id").alias("last_run_id"),
        F.col("status").alias("last_status"),
        iso(F.col("started_at")).alias("last_started_at"),
    )
    return jobs.join(newest, "job_id", "left").orderBy(F.desc("created_at"), "job_id")


def run_stats(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, jobs and runs by state, last run): one row per user.

    Both tables are reduced to one row per user before they meet.
    """
    per_job = jobs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("jobs_total"),
        F.count_if("is_active").alias("jobs_active"),
        F.count("schedule").alias("jobs_scheduled"),
    )
    last = last_runs(runs, "user_id").select("user_id", F.struct("status", "started_at", "finished_at").alias("last"))
    per_run = runs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs_total"),
        F.count_if(F.col("status") == "success").alias("runs_success"),
        F.count_if(F.col("status") == "failed").alias("runs_failed"),
    ).join(last, "user_id", "left")
    joined = per_job.join(per_run, "user_id", "full")
    counts = [
        F.coalesce(c, F.lit(0)).alias(c)
        for c in ("jobs_total", "jobs_active", "jobs_scheduled", "runs_total", "runs_success", "runs_failed")
    ]
    return joined.select(
        "user_id",
        *counts,
        F.col("last.status").alias("last_status"),
        iso(F.col("last.finished_at")).alias("last_finished_at"),
        seconds_between(F.col("last.started_at"), F.col("last.finished_at")).alias("last_seconds"),
    )


def recent_uploads(uploads: DataFrame, limit: int = 20) -> DataFrame:
    """The newest uploads; the limit is kept between 1 and 100."""
    return uploads.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(max(1, min(limit, 100)))


def latest_transform(versions: DataFrame, version: int | None = None) -> DataFrame:
    rows = versions if version is None else versions.where(F.col("version") == version)
    return last_per_group(rows, ["transform"], ["version"])
