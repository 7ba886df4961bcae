"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the table directory, ``BENCH_CPUS`` the local cores.
The test tables are one file of one row group each, which no reader can split,
so they are first landed in as many files as there are cores, before the clock.
Each query runs in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from redgreen.plans.catalog import QUERIES

HEADLINE = [
    "flaky_occurrences", "flaky_runs", "primary_failures", "scan_summary", "workflow_window_scan", "recent_runs_cap",
    "job_log_lookup", "normalise_lines", "failing_step", "excerpt_assembled", "archive_excerpts", "rule_hits",
    "rule_verdicts", "citation_check", "parsed_responses", "repair_round", "eval_totals", "eval_per_category",
    "confusion_pivot", "detail_order", "issue_groups", "report_markdown", "report_digest", "classified_items",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("redgreen-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    landed = tempfile.mkdtemp(prefix="redgreen-bench-")
    for name in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(int(cpus)).write.parquet(f"{landed}/{name}")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, landed).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
