"""Time headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_RUNS`` (default 3
warm runs, of which the median counts) set the run. ``BENCH_QUERIES`` names other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from uqframe.catalogue import registered
from uqframe.sources.session import drop_scratch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "interactions", "basis_to_dry", "clip_overview_stats", "feature_matrix",
    "temperature_weights", "power_transform_profile", "split_groups", "group_kfold",
    "paper_holdout", "parity_table", "interval_report", "problem_groups", "global_conformal",
    "local_conformal_knn", "qq_grid", "density_curve", "box_stats_by_family", "yield_closure",
    "physics_evaluation", "energy_envelope", "rule_counts", "rsm_candidates", "rsm_surfaces",
    "rsm_surface_optimum", "quality_profile", "correlation_matrix", "bootstrap_ci",
]
SLOW = ["model_modes", "forest_intervals"]  # trained once


def run(spark: SparkSession, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("uqframe-bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="uqframe-bench-"))
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    queries = registered()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else None
    times = {}
    for name in names or HEADLINE + SLOW:
        query = queries[name][0]
        if name in SLOW:
            times[name] = round(run(spark, query), 3)
            drop_scratch(spark)
            continue
        run(spark, query)
        times[name] = round(statistics.median(run(spark, query) for _ in range(RUNS)), 3)
        drop_scratch(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
