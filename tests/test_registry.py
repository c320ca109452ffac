"""Registered queries against their SQL on the small tables, and the driver contract."""

import pytest

from tallyforge.registry import load
from tests import verify

SMALL = [
    "M2_exact_reference", "M5_partial_groups", "M7_split_combined", "X_exceptions", "N17_audit_reasons",
    "E1_accuracy_vs_truth", "T1_tax_line_audit", "C3_customer_reliability", "C9_cash_forecast", "S1_bank_ingest_stats",
    "B7_customer_revenue_fact", "B19_longest_prefix_cost", "D16_checked_merge", "D31_running_total_over_raw_events",
    "D36_sessions", "D47_recursive_hierarchy", "K5_regexp", "K19_points_in_polygons", "D67_nearest_targets", "V10_ndcg",
    "V21_roc_auc", "R5_watermark_drops_late_rows", "R12_R14_stream_static_match", "R13_stream_stream_join",
]


@pytest.mark.parametrize("name", SMALL)
def test_equals_sql(spark, tiny, name):
    verdict, detail, _, _ = verify.compare(spark, verify.connect(tiny), load(), name, tiny)
    assert verdict == "ok", detail


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rate_source(spark):
    from tallyforge.streaming import flows

    query = flows.rate_stream(spark, 50).writeStream.format("noop").start()
    try:
        assert query.isActive
    finally:
        query.stop()
