"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilake.plans.registry import REGISTRY  # noqa: E402
from vigilake.session import local_session  # noqa: E402

HEADLINES = [
    "metric_long", "table_profile", "table_profile_heavy", "profile_approx", "catalog_crawl",
    "metric_series", "zscore_outliers", "outlier_series", "forecast_band", "batch_anomalies",
    "schema_diff", "change_detail", "schema_history_diff", "latest_snapshot", "changes_latest",
    "fileset_match", "fileset_validate", "fileset_suggest", "unrecognized_files", "suggestion_validate",
    "cadence_overdue", "loaded_at_gap", "metric_dedupe_append", "arrival_upsert",
    "infer_csv_schema", "infer_json_schema", "payload_schema", "encoding_census", "api_spec_snapshot",
    "tenant_ingest", "scan_payload", "payload_hash", "windowed_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
