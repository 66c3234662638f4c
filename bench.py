"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then three times; the median counts.
Results go to Spark's no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetskein.plans import catalog  # noqa: E402
from fleetskein.session import build_session  # noqa: E402

HEADLINE = [
    "cluster_status",
    "node_list",
    "node_states",
    "offline_nodes",
    "activity_sessions",
    "latest_n",
    "hot_metrics_number",
    "unload_filtered",
    "latest_run_telemetry",
    "all_run_telemetry",
    "control_log",
    "lineage_edges",
    "compacted_artifacts",
    "ingest_ledger",
    "ingest_quarantine",
    "registry_alerts",
    "sensor_nvidia",
    "sensor_amd",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        # The test tables are single small files; split them so that all cores take part.
        "spark.sql.files.maxPartitionBytes": "512k",
        "spark.sql.files.openCostInBytes": "64k",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
