"""Run parameters. Monetary values are integer paise (1/100 INR)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    amount_tolerance: int = 500
    date_tolerance_days: int = 3
    auto_match_confidence: float = 0.85
    needs_review_confidence: float = 0.50
    top_k: int = 3
    min_candidate_score: float = 0.35
    # A reference key whose settlement x order count exceeds this is matched by
    # set-based rounds instead of one in-memory fold per key.
    hot_key_pairs: int = 1024
    # Windows over groups longer than this are ranked range-partition-wise.
    max_window_rows: int = 1_000_000

    @property
    def strict_tolerance(self) -> int:
        return min(self.amount_tolerance, STRICT_TOLERANCE_CAP)


# Fixed values of the reconciliation rules.
STRICT_TOLERANCE_CAP = 500
MDR_RATE = 0.02
GST_RATE = 0.18
ONE_STEP_FEE_RATE = 0.0236
USD_INR_RATE = 83.50
AT_RISK_RECOVERY = 0.25
DEFAULT_LAG_DAYS = 2.0
MANUAL_MINUTES_PER_RECORD = 4.5

RULE_GATEWAY = "GATEWAY_3WAY_TRIANGULATION_MATCH"
RULE_EXACT = "EXACT_REFERENCE_MATCH"
RULE_FEE = "FEE_DEDUCTED_MATCH"
RULE_ROUNDING = "ROUNDING_TOLERANCE_MATCH"
RULE_PARTIAL = "PARTIAL_SETTLEMENT_MATCH"
RULE_SHORTFALL = "PARTIAL_SETTLEMENT_SHORTFALL"
RULE_SPLIT = "SPLIT_COMBINED_SETTLEMENT_MATCH"
RULE_LAG = "TIMING_LAG_MATCH"
RULE_MANUAL = "MANUAL_HUMAN_REMATCH_OVERRIDE"
