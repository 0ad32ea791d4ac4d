"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` (default /root/testdata/sf0.1), `BENCH_CPUS` (default 8), `BENCH_RUNS` timed
runs after one warm-up (default 1; the median counts; 0 times the first run), `BENCH_QUERIES` (comma-separated names, or `all`).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowlens.plans import QUERIES  # noqa: E402

HEADLINE = [
    "a1_table_scan", "a4_log_lines", "a9_kv_pivot", "b1_query_runs", "b7_stuck_jobs", "c1_assemble", "c2_attach_parents",
    "c3_descendants", "c5_pin_images", "c7_missing_contigs", "c9_e5_guess_types", "d1_shard_roll_up", "d3_run_timeline",
    "d4_submission_roll_up", "d16_error_texts", "e4_tail", "e6_latest_rows", "f1_upsert", "f3_change_capture", "g1_cascade",
    "g5_batch_fan_out", "g12_plan_outputs", "h7_h8_h9_image_inventory", "s1_step_scopes",
    "s3_status_changes", "s8_error_streaks", "t1_run_rows", "t2_job_rows", "x3_union_parents",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("flowlens-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
             "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
