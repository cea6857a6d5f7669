"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "win2_connection_split", "agg1_connection_rows", "win5_rolling_gaps", "win6_sequence_windows", "win8_even_sampling",
    "ud1_scored_windows", "agg3_best_window", "agg3_lineitem_groups", "top3_beacons_by_confidence", "prj7_window_scaler",
    "prj5_exact_medians", "flt2_trigger_reasons", "prj11_display_evidence", "prj12_mixtape_evidence",
    "agg9_histogram_statistics", "jn7_connection_details", "win7_behaviour_series", "jn1_detector_merge",
    "top2_threat_order", "jn5_tolerant_overlay", "agg16_evidence_facts", "agg6_hourly_aggregate", "sc12_retrieval_query",
    "win10_stratified_sample", "sc14_evidence_documents", "set8_text_dedup", "jn9_nearest_documents",
    "prj13_attribution_details", "agg21_attribution_summary", "win11_threshold_sweep", "ev3_window_and_group",
    "ev5_detector_metrics", "agg23_timing_statistics", "st1_hourly_stream",
]


def main() -> None:
    from pulseloom import catalog
    from pulseloom.session import local_session

    spark = local_session("bench", cpus=CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    catalog.QUERIES["top3_beacons_by_confidence"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
