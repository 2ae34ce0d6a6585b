"""Headline queries on one machine: prints one JSON line with seconds per query.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corrobora.plans import QUERIES  # noqa: E402
from corrobora.session import build_session  # noqa: E402

HEADLINE = [
    "quarterly_revenue_left", "join_loss_audit", "etl_merge", "expectations", "group_profile", "simpson_check",
    "stratified_sample", "delta_features", "exact_quantiles", "t_tests", "kruskal", "pairwise_holm", "ab_peeking",
    "ols_report", "naive_vs_controlled", "newey_west", "bootstrap_ci", "kaplan_meier", "logrank", "change_point",
    "seasonal_decompose", "daily_anomaly", "target_encode_oof", "pass_at_k", "adf", "cooks", "breusch_pagan",
    "pairwise_mannwhitney", "normality", "stratified_split", "chronological_split",
]


def run(spark, name: str, root: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "corrobora-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, name, root)  # code generation and Python workers warm up
        seconds[name] = round(min(run(spark, name, root) for _ in range(2)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
