"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and once timed, on ``local[$BENCH_CPUS]`` over
``$BENCH_SF_DIR``. Results go to the no-op sink, so every row is computed and none collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from convoy.plans.queries import QUERIES

HEADLINE = (
    "qa_window_rate",
    "qa_violations",
    "qa_rolling",
    "policy_decisions",
    "breaker_timeline",
    "incident_episodes",
    "quarantine_audit",
    "feature_stats",
    "feature_asof",
    "ks_features",
    "ks_order_lines",
    "drift_windows",
    "pass_ratio_5m",
    "latency_quantiles",
    "sensor_fusion",
    "doc_chunks",
    "hash_embed",
    "vector_topk",
    "injection_filter",
    "lake_roundtrip",
    "retrieval",
    "sustained_alerts",
    "slo_report",
    "message_windows",
    "stream_qa_window",
    "stream_breaker",
    "stream_pass_ratio",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
