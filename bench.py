"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR   folder of the tables       (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                (default 8)
BENCH_QUERIES  comma-separated names      (default: the headline queries)
BENCH_RUNS     timed runs, best counts    (default 2)

Each query is built and fully executed into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from muster.plans.queries import QUERIES, shipped_catalog

HEADLINE = [
    "effective_config",
    "render_config",
    "diff_state",
    "merge_layers",
    "validate",
    "effective_config_of_specs",
    "derive_properties",
    "missing_required",
    "desired_objects",
    "fingerprint",
    "select_by_labels",
    "check_expectations",
    "expand_pods",
    "latest_per_key",
    "retry_due",
    "eventually",
    "liveness",
    "reconcile_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("muster-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="muster-bench-"))
        .getOrCreate()
    )
    shipped_catalog(spark)
    rows = {
        t: spark.read.parquet(f"{folder}/{t}.parquet").count()
        for t in ("orders", "lineitem", "events")
    }
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "fleet_configuration_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "input_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
