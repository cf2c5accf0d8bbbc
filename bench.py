"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (3 by default); the
median counts.  Results go to Spark's noop sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = ["v2_knn_batch", "v4_bm25", "v7_score_aware_rrf", "hybrid_search", "e_means", "a4_overview", "a5_top_queries", "w14_hourly", "w5_sessions", "w6_bigrams", "a8_agent_days", "w8_health", "a13_clicks", "w3_diversity", "c1_chunks", "c5_fields", "j12_within_hops"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quern.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries, medians of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
