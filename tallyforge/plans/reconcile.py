"""The batch reconciliation: phases in order, each on what the earlier ones left free."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyforge import settings as fixed
from tallyforge.functions import money, text
from tallyforge.operators import adjudicate, classify, matchers, shortlist
from tallyforge.session import cut
from tallyforge.settings import Settings

# Phase number and confidence of every rule.
PHASE = {
    fixed.RULE_GATEWAY: 1, fixed.RULE_EXACT: 2, fixed.RULE_FEE: 3, fixed.RULE_ROUNDING: 4,
    fixed.RULE_PARTIAL: 5, fixed.RULE_SHORTFALL: 6, fixed.RULE_SPLIT: 7, fixed.RULE_LAG: 8,
}
CONFIDENCE = {fixed.RULE_SHORTFALL: 0.95, fixed.RULE_LAG: 0.90}
ADJUDICATION_PHASE = 9


@dataclass
class Reconciliation:
    matches: DataFrame  # settlement_id, order_id, rule_applied, confidence, phase, status, payout_id
    free_bank: DataFrame
    free_ledger: DataFrame
    candidates: DataFrame | None = None  # bank-side candidate rows
    outcomes: DataFrame | None = None  # routed decisions


def _from_map(values: dict, key, default):
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def _tagged(found: DataFrame) -> DataFrame:
    rule = F.col("rule_applied")
    return found.select(
        "settlement_id", "order_id", "rule_applied",
        _from_map(CONFIDENCE, rule, 1.0).alias("confidence"),
        _from_map(PHASE, rule, 0).cast("int").alias("phase"),
        F.lit("matched").alias("status"),
        (F.col("payout_id") if "payout_id" in found.columns else F.lit(None).cast("string")).alias("payout_id"),
    )


def match_phases(
    bank: DataFrame, ledger: DataFrame, gateway: DataFrame | None = None, settings: Settings = Settings()
) -> DataFrame:
    """M1-M8 in order."""
    return matches_and_free(bank, ledger, gateway, settings)[0]


def matches_and_free(
    bank: DataFrame, ledger: DataFrame, gateway: DataFrame | None = None, settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1-M8 in order, and the settlements and orders that are left. Each phase's
    pairs are written once, and so are the rows that a phase leaves for the next:
    a row that is matched is not read again, and an anti-join meets the pairs of
    one phase only."""
    found: DataFrame | None = None
    phases = [
        matchers.match_exact_then_tolerance, matchers.match_partial, matchers.match_split,
        matchers.match_timing_lag,
    ]
    if gateway is not None:
        phases.insert(0, lambda b, l, s: matchers.match_triangulation(b, gateway, l, s))
    b, l = bank, ledger
    for i, phase in enumerate(phases, start=1):
        new = cut(_tagged(phase(b, l, settings)), "matches")
        found = new if found is None else found.unionByName(new)
        b, l = matchers.unmatched(b, new, "settlement_id"), matchers.unmatched(l, new, "order_id")
        if i < len(phases):
            b, l = cut(b, "free-bank"), cut(l, "free-ledger")
    return found, b, l


def reconcile(
    bank: DataFrame,
    ledger: DataFrame,
    gateway: DataFrame | None = None,
    settings: Settings = Settings(),
    adjudication: bool = False,
    decisions: DataFrame | None = None,
    local_scorer: bool = True,
) -> Reconciliation:
    matches, free_b, free_l = matches_and_free(bank, ledger, gateway, settings)
    if not adjudication:
        return Reconciliation(matches, free_b, free_l)
    free_b, free_l = cut(free_b, "free-bank"), cut(free_l, "free-ledger")
    listed = shortlist.shortlist(
        shortlist.bank_records(free_b), shortlist.ledger_records(free_l), settings)
    rows = cut(adjudicate.candidate_rows(listed, free_b, free_l), "candidates")
    outcomes = cut(
        adjudicate.route(
            adjudicate.decide(rows, settings, decisions, local_scorer), free_b, settings), "outcomes")
    logged = outcomes.filter(F.col("rule_applied").isNotNull()).select(
        "settlement_id", F.col("matched_order_id").alias("order_id"), "rule_applied", "confidence",
        F.lit(ADJUDICATION_PHASE).alias("phase"),
        F.when(F.col("outcome") == "auto_matched", "matched").otherwise("review").alias("status"),
        F.lit(None).cast("string").alias("payout_id"))
    matches = matches.unionByName(logged)
    taken = matches.filter("status = 'matched'")
    return Reconciliation(
        matches, matchers.unmatched(free_b, taken, "settlement_id"),
        matchers.unmatched(free_l, taken, "order_id"), rows, outcomes)


def classify_unmatched(
    result: Reconciliation, bank: DataFrame, as_of: dt.date | str, settings: Settings = Settings()
) -> DataFrame:
    """Exceptions of both sides. Ledger-side candidates come from the reverse shortlist."""
    settled = matchers.settled_references(bank, result.matches)
    top = pending = None
    if result.candidates is not None:
        top = result.candidates.filter("rank = 1")
        pending = result.outcomes.filter("outcome = 'pending_verification'").select(
            "settlement_id", F.col("reasoning").alias("pending_reason"))
    bank_side = classify.classify_bank(result.free_bank, settled, top, pending)
    ledger_top = None
    if result.candidates is not None:
        reverse = shortlist.shortlist(
            shortlist.ledger_records(result.free_ledger), shortlist.bank_records(result.free_bank), settings)
        ledger_top = (
            reverse.filter("rank = 1")
            .select(F.col("record_id").alias("order_id"), F.col("candidate_id").alias("settlement_id"))
            .join(result.free_bank.select("settlement_id", "net_amount"), "settlement_id"))
    return bank_side.unionByName(classify.classify_ledger(result.free_ledger, as_of, ledger_top))


def with_reasons(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """The audit sentence of every match; timing-lag matches have none."""
    s = bank.select("settlement_id", "net_amount", "utr_reference", "description", "payer_account")
    o = ledger.select("order_id", "expected_amount", "customer_reference")
    joined = matches.join(s, "settlement_id").join(o, "order_id")
    per_order = joined.groupBy("order_id").agg(F.sum("net_amount").alias("group_net"))
    per_settlement = joined.groupBy("settlement_id").agg(F.sum("expected_amount").alias("batch_gross"))
    joined = joined.join(per_order, "order_id").join(per_settlement, "settlement_id")

    def rupees(c):
        return F.concat(F.lit("₹"), money.inr_text(c))

    sid, oid, net, e = (F.col(c) for c in ("settlement_id", "order_id", "net_amount", "expected_amount"))
    empty = F.col("utr_reference").isNull() | (F.col("utr_reference") == "")
    used_ref = F.when(empty, text.found(F.col("description"), text.REF_WORD)).otherwise(F.col("utr_reference"))
    fee, net2, total = money.mdr_fee(e), money.two_step_net(e), F.col("group_net")
    gross = F.col("batch_gross")

    def sentence(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    whole = lambda c: c.cast("string")
    reason = (
        F.when(
            F.col("rule_applied") == fixed.RULE_GATEWAY,
            sentence(
                "3-Way Triangulation Verified: Bank Settlement ", sid, " (Net ", rupees(net),
                ") <--> Gateway Payout ", F.col("payout_id"), " <--> ERP Order ", oid, " (Gross ", rupees(e), ", MDR 2% ", rupees(fee), ")"),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_EXACT,
            sentence(
                "Exact Reference Verified: Settlement ", sid, " (Ref: '", used_ref, "') matched Order ", oid,
                " (Ref: '", text.reference_key(used_ref), "') within ", whole(F.abs(net - e)),
                " paise variance."),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_FEE,
            sentence(
                "Fee Deduction Verified: Gross ", rupees(e), " - MDR Fee 2% ", rupees(fee), " - GST 18% ",
                rupees(money.gst_on_fee(e)), " = Expected Net ", rupees(net2), " (Bank Net ", rupees(net),
                ", Variance ", whole(F.abs(net - net2)), " paise)"),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_ROUNDING,
            sentence(
                "Rounding Tolerance Verified: Bank Net ", rupees(net), " matched Ledger Expected ", rupees(e),
                " within ", whole(F.abs(net - e)), " paise."),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_PARTIAL,
            sentence(
                "Partial Payment Group Verified: Reference '",
                text.settlement_group_reference(F.col("utr_reference"), F.col("description")),
                "' matched Order ", oid, " (Total Bank Net ", rupees(total), " vs Expected Net ", rupees(net2),
                ")"),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_SHORTFALL,
            sentence(
                "Partial settlement group underpaid by ", rupees(net2 - total), " (total bank net ",
                rupees(total), " vs expected net ", rupees(net2), ")"),
        )
        .when(
            F.col("rule_applied") == fixed.RULE_SPLIT,
            sentence(
                "Split Batch Settlement Verified: Settlement ", sid, " (Net ", rupees(net),
                ") matched batch orders for Payer '", text.reference_key(F.col("payer_account")),
                "' (Total Gross ", rupees(gross), ", Expected Net ", rupees(money.two_step_net(gross)), ")"),
        )
    )
    return joined.select(*matches.columns, reason.alias("reason"))
