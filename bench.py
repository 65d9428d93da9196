"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is written to the ``noop`` sink (every column computed, nothing
collected); one warm-up run, then the median of ``$BENCH_RUNS`` (default 3)
timed runs.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "hourly_mean", "hourly_wide", "hourly_join", "dedupe_first", "missing_hours", "time_completeness",
    "describe_stats", "iqr_outliers", "daily_multi_agg", "rolling7_centered", "interpolate_limit",
    "missingness_class", "winsorize", "final_table", "pearson_matrix", "spearman_matrix",
    "lag_correlation", "box_by_month", "sector_mean", "hypothesis_verdicts", "quality_checks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")

    from envseries.plans.catalog import REGISTRY
    from envseries.session import local_session

    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus))
    spark = local_session(cpus, shuffle, app="envseries-bench")
    selected = list(REGISTRY) if names == "all" else (names.split(",") if names else HEADLINE)

    times = {}
    for name in selected:
        build = REGISTRY[name].build

        def run():
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up (plan caches, JIT)
        times[name] = round(statistics.median(run() for _ in range(runs)), 4)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "shuffle_partitions": shuffle,
        "runs": runs,
        "driver_memory": spark.conf.get("spark.driver.memory", None),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
