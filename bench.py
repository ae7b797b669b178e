"""Seconds per headline query, warm: each query runs once unmeasured, then once measured, into a
sink that keeps nothing. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.catalog import registered  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    "j1_conn_ssl_join",
    "j2_correlate_logs",
    "feat_flow_vector",
    "w1_first_sightings",
    "r2_tls_risk",
    "r6_alert_records",
    "p6_flow_record",
    "risk_unfitted_severity",
    "a1_traffic_totals",
    "a5_fingerprint_stats",
    "a7_attack_share",
    "a9_feature_moments",
    "a11_percentile_threshold",
    "k3_top_fingerprints",
    "k6_dedup_by_uid",
    "w2_stat_ewma",
    "w3_sliding_sequences",
    "w5_flow_windows",
    "w7_block_ledger",
    "d_iso_scores",
    "d_rf_scores",
    "d_seq_scores",
    "j2_stream_sessions",
    "live_scoring",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = build_session("tidewatch-bench")
    queries, seconds = registered(), {}
    for name in only:
        for measured in (False, True):
            start = time.perf_counter()
            queries[name].build(spark, sf).write.format("noop").mode("overwrite").save()
            if measured:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
