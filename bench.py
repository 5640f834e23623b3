"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 2, the faster run counts) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemill import plans
from tidemill.session import build_session

HEADLINE = [
    "tumble_hourly_metrics",
    "hop_from_panes",
    "hop_distinct_users",
    "session_windows",
    "session_from_panes",
    "cumulate_from_panes",
    "cascade_hour_to_day",
    "ranking_functions",
    "lag_and_lead",
    "running_aggregates",
    "moving_aggregates",
    "deduplicate_keep_first",
    "inner_join",
    "dimension_joins",
    "interval_join_inner",
    "interval_join_left",
    "as_of_join_left",
    "validity_range_join",
    "text_containment_join",
    "geofence_containment",
    "latest_row_per_key",
    "pricing_summary",
    "count_variants",
    "violation_rows",
    "check_results",
    "foreign_key_match_rate",
    "throughput_per_window",
    "match_browse_to_purchase",
    "match_rising_values",
    "ml_predict",
    "payment_fraud_scores",
    "campaign_attribution",
    "exposure_limit_breaches",
    "fraud_blocks",
    "customer_360",
    "stream_tumble_on_close",
    "stream_interval_join",
    "stream_violations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    plans.QUERIES["pricing_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
