"""Data-quality rules: generated from a profile, evaluated in one aggregate."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import session
from feedloom.functions.numbers import percent
from feedloom.operators.latest import last_per_group
from feedloom.operators.profile import value_frequencies
from feedloom.types import col, field, logical_type, missing, present

RULE_SCHEMA = (
    "rule_id string, column string, rule_type string, threshold double, severity string, "
    "description string, is_manual boolean"
)

#: Unparseable share, in percent, above which a date rule fails.
PARSE_FAILURE_LIMIT = 10.0


def _rule(column: Column, kind: str, threshold: Column, severity: str, text: Column) -> Column:
    return F.struct(
        F.concat_ws(":", F.lit(kind), column).alias("rule_id"),
        column.alias("column"),
        F.lit(kind).alias("rule_type"),
        threshold.cast("double").alias("threshold"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
        F.lit(False).alias("is_manual"),
    )


def generate_rules(profile: DataFrame) -> DataFrame:
    """Automatic rules of a table, from its column profile."""
    name, none = F.col("column"), F.lit(None).cast("string")
    least = F.greatest(F.lit(1.0), F.floor(F.col("rows") * F.lit(0.9)).cast("double"))
    ceiling = F.least(F.lit(100.0), F.col("null_percent") + 10.0)
    rules = F.array_compact(
        F.array(
            F.when(
                (F.col("ordinal") == 0) & (F.col("rows") > 0),
                _rule(
                    none, "row_count_min", least, "warn",
                    F.format_string("Ensure at least %d rows (90%% of profiled count).", least.cast("bigint")),
                ),
            ),
            _rule(
                name, "null_ratio_max", ceiling, "warn",
                F.format_string("%s null ratio should remain below %.1f%%.", name, ceiling),
            ),
            F.when(
                F.col("is_key_candidate"),
                _rule(
                    name, "uniqueness", F.lit(0.0), "error",
                    F.concat(name, F.lit(" should remain unique (primary key candidate).")),
                ),
            ),
            F.when(
                F.col("logical_type") == "datetime",
                _rule(
                    name, "datetime_parseable", F.lit(None), "warn",
                    F.concat(name, F.lit(" should contain parseable datetimes.")),
                ),
            ),
        )
    )
    return profile.select(F.explode(rules).alias("r")).select("r.*")


def sync_rules(existing: DataFrame, profile: DataFrame) -> DataFrame:
    """Manual rules are kept, automatic ones replaced by those of the profile."""
    return existing.where("is_manual").unionByName(generate_rules(profile))


def _unparseable(f: T.StructField) -> Column:
    if logical_type(f.dataType) == "datetime":
        return F.lit(False)
    return present(f) & F.try_to_timestamp(col(f.name).cast("string")).isNull()


def measure(
    df: DataFrame,
    null_columns: Sequence[str],
    unique_columns: Sequence[str],
    date_columns: Sequence[str],
    sample: int | None = None,
) -> DataFrame:
    """(column, total, nulls, distinct, parsed, parse_failures); NULL column is the table.

    One aggregate covers every null and date check, and distinct counts add one
    shuffle per unique column. ``sample`` looks at that many non-missing
    values per date column instead of all.
    """
    checks = {c: field(df, c) for c in dict.fromkeys([*null_columns, *unique_columns, *date_columns])}
    seen = list(checks)
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(missing(f)).alias(f"nulls_{i}") for i, f in enumerate(checks.values())],
        *[
            F.count_if(_unparseable(checks[c])).alias(f"bad_{seen.index(c)}")
            for c in date_columns
            if sample is None
        ],
    )
    none = F.lit(None).cast("bigint")
    entries = [
        F.struct(
            F.lit(None).cast("string").alias("column"), F.col("total"), none.alias("nulls"),
            none.alias("parsed"), none.alias("parse_failures"),
        )
    ]
    for i, c in enumerate(seen):
        dated = c in date_columns and sample is None
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col("total"),
                F.col(f"nulls_{i}").alias("nulls"),
                (F.col("total") - F.col(f"nulls_{i}") if dated else none).alias("parsed"),
                (F.col(f"bad_{i}") if dated else none).alias("parse_failures"),
            )
        )
    measured = wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if unique_columns:
        names = session.literal_rows(df.sparkSession, list(enumerate(unique_columns)), "ordinal int, column string")
        distinct = (
            value_frequencies(df, unique_columns)
            .groupBy("ordinal")
            .agg(F.count("value").alias("distinct"))
            .join(F.broadcast(names), "ordinal")
            .select("column", "distinct")
        )
        # One row per checked column.
        measured = measured.join(F.broadcast(distinct), "column", "left")
    else:
        measured = measured.withColumn("distinct", none)
    if sample is not None and date_columns:
        measured = measured.drop("parsed", "parse_failures").join(
            F.broadcast(_sampled_dates(df, date_columns, sample)), "column", "left"
        )
    return measured.select("column", "total", "nulls", "distinct", "parsed", "parse_failures")


def _sampled_dates(df: DataFrame, columns: Sequence[str], sample: int) -> DataFrame:
    out = None
    for c in columns:
        f = field(df, c)
        part = (
            df.where(present(f))
            .limit(sample)
            .agg(F.count(F.lit(1)).alias("parsed"), F.count_if(_unparseable(f)).alias("parse_failures"))
            .select(F.lit(c).alias("column"), "parsed", "parse_failures")
        )
        out = part if out is None else out.unionAll(part)
    return out


def evaluate_rules(
    df: DataFrame, rules: DataFrame, sample: int | None = None, run_id: str | None = None
) -> DataFrame:
    """One row per rule with status pass, fail or skip, and details.

    The rows are a result log as :func:`rule_status` reads it: result_id (``run_id``, a random one
    unless given, and the rule) and created_at.

    The checks a table needs are read from the rules first (a few rows per
    column); the table itself is then measured once for all rules. Rules about
    columns the table lacks, and unknown rule types, are skipped.
    """
    wanted = {
        kind: [c for c in columns if c in df.columns]
        for kind, columns in (
            (r["rule_type"], r["columns"])
            for r in rules.where(F.col("column").isNotNull())
            .groupBy("rule_type")
            .agg(F.sort_array(F.collect_set("column")).alias("columns"))
            .collect()
        )
    }
    facts = measure(
        df,
        wanted.get("null_ratio_max", []),
        wanted.get("uniqueness", []),
        wanted.get("datetime_parseable", []),
        sample,
    )
    joined = rules.join(
        F.broadcast(facts.withColumnRenamed("column", "__column")),
        F.col("column").eqNullSafe(F.col("__column")),
        "left",
    )
    kind, total = F.col("rule_type"), F.col("total")
    null_share = percent(F.col("nulls"), total, 2)
    duplicates = total - F.col("distinct")
    bad_share = percent(F.col("parse_failures"), F.col("parsed"), 1)

    def verdict(ok: Column) -> Column:
        return F.when(ok, "pass").otherwise("fail")

    table_rule = kind == "row_count_min"
    status = (
        F.when(table_rule & total.isNotNull(), verdict(total >= F.coalesce("threshold", F.lit(1.0))))
        .when(total.isNull() | F.col("column").isNull() | (total == 0), "skip")
        .when(kind == "null_ratio_max", verdict(null_share <= F.coalesce("threshold", F.lit(100.0))))
        .when(kind == "uniqueness", verdict(duplicates <= F.coalesce("threshold", F.lit(0.0))))
        .when((kind == "datetime_parseable") & (F.coalesce("parsed", F.lit(0)) == 0), "skip")
        .when(kind == "datetime_parseable", verdict(bad_share <= PARSE_FAILURE_LIMIT))
        .otherwise("skip")
    )
    actual = (
        F.when(table_rule, total.cast("double"))
        .when(kind == "null_ratio_max", null_share)
        .when(kind == "uniqueness", duplicates.cast("double"))
        .when(kind == "datetime_parseable", bad_share)
    )
    details = F.map_filter(
        F.create_map(
            F.lit("total"), total.cast("double"),
            F.lit("nulls"), F.when(kind == "null_ratio_max", F.col("nulls").cast("double")),
            F.lit("distinct"), F.when(kind == "uniqueness", F.col("distinct").cast("double")),
            F.lit("checked"), F.when(kind == "datetime_parseable", F.col("parsed").cast("double")),
            F.lit("parse_failures"),
            F.when(kind == "datetime_parseable", F.col("parse_failures").cast("double")),
            F.lit("threshold"), F.col("threshold"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return joined.select(
        *[F.col(f.name) for f in rules.schema.fields],
        status.alias("status"),
        F.when(status != "skip", actual).alias("actual"),
        details.alias("details"),
        F.current_timestamp().alias("created_at"),
        F.concat_ws(":", F.lit(run_id or uuid.uuid4().hex), "rule_id").alias("result_id"),
    )


def log_results(results: DataFrame, path: str) -> None:
    """Add evaluated rules to a stored result log."""
    results.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def summarize(results: DataFrame) -> DataFrame:
    """One row: passed, failed, skipped, total and the overall status."""
    counted = results.agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )
    overall = F.when(F.col("total") == 0, "no_rules").when(F.col("failed") == 0, "pass").otherwise("fail")
    return counted.select(overall.alias("status"), "passed", "failed", "skipped", "total")


def rule_status(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Each rule with its latest result; a rule without one is ``pending``."""
    newest = last_per_group(results, ["rule_id"], ["created_at", "result_id"]).select(
        "rule_id", "status", "details", F.col("created_at").alias("evaluated_at")
    )
    return rules.join(newest, "rule_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def feed_status(statuses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of rule statuses: fail if any failed, pending without rules.

    Rules still pending count among the passes, as the feed view shows them.
    """
    counted = statuses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
    )
    overall = F.when(F.col("failed") > 0, "fail").when(F.col("total") > 0, "pass").otherwise("pending")
    return counted.select(
        *by,
        overall.alias("status"),
        "total",
        (F.col("total") - F.col("failed") - F.col("skipped")).alias("passed"),
        "failed",
        "skipped",
    )


def error_failures(results: DataFrame, limit: int | None = 5) -> DataFrame:
    """The first failed rules of severity error, each with ``failed_in_all``, how many there are.

    Rules are a few rows per column, so one task counts them. No limit returns all.
    """
    failed = results.where((F.col("status") == "fail") & (F.col("severity") == "error"))
    failed = failed.withColumn("failed_in_all", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return failed.orderBy("rule_id") if limit is None else failed.orderBy("rule_id").limit(limit)


def freshness(df: DataFrame, column: str, as_of: str, max_age: str = "1 day") -> DataFrame:
    """One row: the newest time, and whether it is recent enough on ``as_of``."""
    f = field(df, column)
    newest = df.agg(F.max(col(f.name)).alias("newest"))
    bound = F.expr(f"timestamp_ntz'{as_of}' - interval {max_age}")
    recent = F.coalesce(F.col("newest").cast("timestamp_ntz") >= bound, F.lit(False))
    return newest.select("newest", F.when(recent, "pass").otherwise("fail").alias("status"))
