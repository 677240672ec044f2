"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "mask_pattern_counts", "learned_templates", "roundtrip_documents", "reconstruct_entries", "multiline_groups", "top_templates", "search_templates", "anomalies",
    "template_counts_window", "template_counts_baseline", "new_templates", "timeseries_hourly", "slot_top_values", "slot_numeric", "query_structured_filtered", "query_lines",
    "replay_window", "raw_logs_search", "investigate_spikes", "stats",
)
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from stratalog import catalog
    from stratalog import fixtures

    def run(make) -> float:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times: dict[str, float] = {}
    groups = fixtures.event_groups(spark, SF_DIR)
    began = time.perf_counter()
    catalog.Store(spark, f"file://{shared}/first").ingest(groups, label="events", now_ms=catalog.NOW)
    times["ingest"] = time.perf_counter() - began
    store = catalog.fixture_store(spark, SF_DIR)  # the same and some raw rows, for the queries
    lines, size = groups.selectExpr("count(*)", "sum(octet_length(header) + 1)").first()
    began = time.perf_counter()
    warm = catalog.Store(spark, f"file://{shared}/again")
    warm.ingest(groups, label="events", now_ms=catalog.NOW)
    times["ingest_warm"] = time.perf_counter() - began
    began = time.perf_counter()
    warm.compact()
    times["compact"] = time.perf_counter() - began
    for name in HEADLINE:
        make = lambda: catalog.QUERIES[name](spark, SF_DIR)  # noqa: B023, E731
        run(make)
        times[name] = statistics.median(run(make) for _ in range(RUNS))
    stored = warm.size_bytes()
    print(
        json.dumps(
            {
                "metric": "total warm time of ingest, compaction and the headline queries",
                "value": round(sum(v for k, v in times.items() if k != "ingest"), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": Path(SF_DIR).name,
                "lines": lines,
                "ingest_lines_per_s": round(lines / times["ingest_warm"]),
                "source_mb": round(size / 1e6, 3),
                "stored_mb_after_compact": round(stored / 1e6, 3),
                "reduction": round(1 - stored / size, 3),
            }
        )
    )
    assert store.path
    spark.stop()


if __name__ == "__main__":
    main()
