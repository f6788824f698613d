"""Times the headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "alert_counts_by_device",
    "validation_reasons",
    "batch_response",
    "dedup_in_batch",
    "insert_new",
    "alerts_all",
    "alerts_threshold_history",
    "events_page1",
    "walk_pages",
    "latest_per_device",
    "recent_trend",
    "device_report",
    "report_totals",
    "findings",
    "run_totals",
    "latency_summary",
    "timeline",
    "timeline_summary",
    "compare_runs",
    "lag_histogram",
    "scrape_series",
    "counter_deltas",
    "metrics_as_of",
    "export_ndjson_rows",
    "import_csv_rows",
    "stream_ingest_stored",
]


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The benchmark tables in several files, as a large table has them: a file of one row group is one task."""
    folder = tempfile.mkdtemp(prefix="plantpulse-bench-")
    for name in ("events",):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from plantpulse.plans.queries import QUERIES
    from plantpulse.session import build_session

    spark = build_session(
        "plantpulse-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plantpulse-bench-checkpoints-"),
            # The test tables are a few MB: let them spread over the cores all the same.
            "spark.sql.files.openCostInBytes": "65536",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    tables = laid_out(spark, sf_dir, int(cpus))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The better of two runs: class loading and code generation of the first are not part of the figures.
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
