"""Headline timings at $BENCH_SF_DIR: one JSON line, warm median per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from recspark.plans.all_queries import QUERIES
from recspark.session import local_session

HEADLINE = {
    "signals": ("item_signals", 3), "affinity": ("tag_affinity", 3), "bandit_sums": ("bandit_sums", 3), "knn": ("similar_items", 3),
    "facets": ("faceted_counts", 3), "sessions": ("cohort_sessions", 3), "recommend": ("recommendations", 3), "kmeans_step": ("cluster_step", 3),
    "kmeans": ("cluster_rounds", 3),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, (query, runs) in HEADLINE.items():
        taken = []
        for i in range(runs + 1):  # the first warms up
            start = time.perf_counter()
            QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
