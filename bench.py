"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median is reported.
Results go to Spark's no-op sink, so every row is computed and none is fetched.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom.session import local_session  # noqa: E402
from feedloom.suite import QUERIES  # noqa: E402

HEADLINES = (
    "profile_nulls", "profile_distinct", "profile_numeric", "profile_approximate", "top_values",
    "group_mean_best_worst", "correlation_pairs", "drift_columns", "dq_results", "cleaned_orders",
    "step_join", "join_outer_null_safe", "dedup_first", "dedup_any", "duplicate_groups", "upsert_by_key",
    "filter_phrase", "chunk_documents", "chunk_ids", "context_pack", "knn_exact", "question_routing",
    "direct_answers", "guarded_sql_topk", "run_stats", "version_decision", "table_fingerprint",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("feedloom-bench", cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chosen = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in chosen:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
