"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "h0_heuristic_score", "g11_matched_titles", "c4_related_pairs", "c8_correlated_score", "c14_related_to", "e2_decayed_score",
    "e6_decay_transitions", "e9_snapshot", "m16_new_outbound", "m22_abuse_events", "i5_threat_intel", "a7_features",
    "a11_forest_score", "r0_score_events", "r0_with_anomaly",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from hostwarden.catalog.all import QUERIES
    from hostwarden.session import local_session
    from hostwarden.sources.sample_tables import ingested

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "hostwarden-bench")
    times: dict[str, float] = {}
    start = time.time()
    for table in ("telemetry", "process_snapshots", "connection_snapshots", "file_snapshots", "resource_samples"):
        ingested(spark, sf_dir, table)
    times["ingest"] = round(time.time() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
