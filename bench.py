"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "reconcile_rule_counts", "M1_gateway_triangulation", "M2_M4_fused_reference_phases", "M5_partial_groups",
    "M7_split_combined", "M8_timing_lag", "F9_shortlist", "X_exceptions", "E1_accuracy_vs_truth", "T1_tax_line_audit",
    "C3_customer_reliability", "C9_cash_forecast", "P3_P5_point_lookups", "S1_bank_ingest_stats", "B5_typed_staging",
    "B7_customer_revenue_fact", "B18_usage_by_date_and_model", "D7_range_filter", "D11_skewed_join_salted",
    "D17_aggregates_with_filter", "D36_sessions", "D53_cohort_retention", "K18_radius_join", "V4_near_copies", "V13_psi",
    "V19_nearest_neighbours", "R12_R14_stream_static_match",
]


def main():
    from tallyforge.registry import load
    from tallyforge.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().queries
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # session start is not part of a query
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name:40}{took[name]:9.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
