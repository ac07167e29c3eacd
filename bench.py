"""Time the headline queries; print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of threads. Each
query runs once to warm up and then three times; the median counts. A run
computes every column of every row (the ``noop`` sink) and moves nothing to
the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "pipe_flagship",
    "pipe_join_chain",
    "trn_filter",
    "trn_aggregate_multi",
    "trn_join_inner",
    "trn_join_outer",
    "trn_window_row_number",
    "trn_window_running_sum",
    "trn_window_partition_total",
    "trn_window_order_only",
    "pii_all",
    "pii_report",
    "ra_snapshot_diff",
    "ra_snapshot_diff_changes",
    "ra_fingerprint",
    "ra_overlay",
    "ra_check_rows",
    "ra_duplicates",
    "ra_orphans_orders",
    "ra_existence",
    "sql_tpch_q1",
    "sql_tpch_q3",
    "sql_tpch_q5",
    "sql_tpch_q6",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from etlspec.catalogue import CATALOGUE

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("etlspec-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        CATALOGUE[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(3)), 4)
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
