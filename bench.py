"""Time the headline queries and print one JSON line.

Each query starts from the given tables: nothing derived for one query is used by another.
BENCH_SF_DIR and BENCH_CPUS choose data and cores; BENCH_RUNS how often each query runs (the
median counts, the first run warms up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "interval_union", "timeline_tiling", "labelled_timeline", "overlap_winner", "discourse_walk", "ordered_metrics",
    "published_timeline", "token_runs", "stitched_segments", "quality_signals", "backend_scores", "contender_ranking",
    "label_scores_by_sheet", "pending_work", "spectral_flatness",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from checks import queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("turnlake-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.cache.maxEntries", "2000")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        took = []
        for _ in range(runs):
            queries.forget_corpora()
            began = time.perf_counter()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:] or took), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
