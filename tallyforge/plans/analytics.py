"""E, T, C, Q, L, P and W: reports over the reconciled tables.

``matches`` is the audit log (settlement_id, order_id, rule_applied,
confidence, phase). Sums are kept in whole paise and divided at the end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge import settings as fixed
from tallyforge.functions import money, text
from tallyforge.session import cut


def _ratio(a: Column, b: Column, default: float = 1.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def _date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def audited(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Audit log x bank x ledger."""
    return matches.join(bank.drop("ingest_seq", "currency"), "settlement_id").join(
        ledger.drop("status"), "order_id")


# --------------------------------------------------------------------- evaluation

def predictions(matches: DataFrame, truth: DataFrame | None) -> DataFrame:
    """Every match with its flag; without a ground truth all count as true."""
    if truth is None:
        return matches.withColumn("is_true", F.lit(True))
    pairs = truth.groupBy("settlement_id", "order_id").agg(
        F.max_by("is_true_match", "ingest_seq").alias("is_true")
        if "ingest_seq" in truth.columns else F.bool_or("is_true_match").alias("is_true"))
    return matches.join(pairs, ["settlement_id", "order_id"], "left").withColumn(
        "is_true", F.coalesce("is_true", F.lit(False)))


def evaluate(
    matches: DataFrame, bank: DataFrame, truth: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """One row of accuracy metrics."""
    flags = predictions(matches, truth).agg(
        F.count_if("is_true").alias("tp"), F.count_if(~F.col("is_true")).alias("fp"),
        F.countDistinct("settlement_id").alias("matched_settlements"),
        F.count("*").alias("system_matches_count"))
    true_total = (
        matches.agg(F.count("*").alias("total_true_matches")) if truth is None
        else truth.agg(F.count_if("is_true_match").alias("total_true_matches")))
    total = bank.agg(F.count("*").alias("total_settlements"))
    exc = (
        bank.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_exceptions")) if exceptions is None
        else exceptions.agg(F.count("*").alias("n_exceptions")))
    tp, fp, true_n = F.col("tp"), F.col("fp"), F.col("total_true_matches")
    one_row = flags.join(true_total, F.lit(True)).join(total, F.lit(True)).join(exc, F.lit(True))
    scored = one_row.withColumns({
        "fn": F.greatest(F.lit(0), true_n - tp),
        "tn": F.when(F.col("n_exceptions") > 0, F.col("n_exceptions")).otherwise(
            F.greatest(F.lit(0), true_n * 2 - fp)),
        "p": _ratio(tp, tp + fp),
        "r": _ratio(tp, true_n),
    })
    fn, tn, p, r = F.col("fn"), F.col("tn"), F.col("p"), F.col("r")
    return scored.select(
        F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"),
        F.bround(_ratio(2 * p * r, p + r), 4).alias("f1_score"),
        F.bround(_ratio(tp + tn, tp + fp + fn + tn), 4).alias("overall_accuracy"),
        F.bround(_ratio(F.col("matched_settlements"), F.col("total_settlements"), 0.0), 4).alias("match_rate"),
        "total_settlements", "system_matches_count", "tp", "fp", "fn", "tn", "total_true_matches")


def rule_breakdown(matches: DataFrame) -> DataFrame:
    """E4."""
    return matches.groupBy(F.coalesce("rule_applied", F.lit("UNKNOWN")).alias("rule_applied")).agg(
        F.count("*").alias("n"))


def batch_summary(matches: DataFrame, bank: DataFrame, needs_review: Column, pending: Column) -> DataFrame:
    """E5. The rate counts audit rows, so 1:N matches can push it above 100."""
    total = bank.agg(F.count("*").alias("total_bank_settlements"))
    found = matches.agg(F.count("*").alias("matched_count"))
    n, t = F.col("matched_count"), F.col("total_bank_settlements")
    return total.join(found, F.lit(True)).select(
        t, n, F.bround(_ratio(n, t, 0.0) * 100, 2).alias("match_rate_percent"),
        needs_review.cast("long").alias("needs_review_count"),
        pending.cast("long").alias("pending_verification_count"),
        F.greatest(F.lit(0), t - n - needs_review).cast("long").alias("exception_count"))


def baseline_and_full(
    matches: DataFrame, bank: DataFrame, truth: DataFrame, baseline_phase: int = 4
) -> DataFrame:
    """The metrics after exact and tolerance matching, and at the end."""
    first = evaluate(matches.filter(F.col("phase").between(2, baseline_phase)), bank, truth)
    return first.withColumn("stage", F.lit("baseline")).unionByName(
        evaluate(matches, bank, truth).withColumn("stage", F.lit("full")))


def effort_saved(bank: DataFrame, elapsed_seconds: float) -> DataFrame:
    """E7, from a measured run time."""
    n = F.col("total_records")
    minutes = fixed.MANUAL_MINUTES_PER_RECORD
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    return bank.agg(F.count("*").alias("total_records")).select(
        n, some(F.bround(n / elapsed_seconds, 1)).alias("records_per_second"),
        F.bround(n * minutes / 60, 2).alias("manual_hours_equivalent"),
        some(
            F.bround((1.0 - F.lit(elapsed_seconds) / F.greatest(F.lit(1.0), n * minutes * 60)) * 100, 2)
        ).alias("time_saved_percent"))


def exceptions_by_category(exceptions: DataFrame) -> DataFrame:
    """E8."""
    return exceptions.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def outcome_shares(matched: DataFrame, review: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Count and share of matched, review and exception rows."""
    parts = None
    for label, df in (("Auto-Matched", matched), ("Needs Review", review), ("Exceptions", exceptions)):
        one = df.agg(F.count("*").alias("n")).withColumn("label", F.lit(label))
        parts = one if parts is None else parts.unionByName(one)
    total = parts.agg(F.sum("n").alias("total"))
    return parts.join(total, F.lit(True)).select(
        "label", "n", F.bround(_ratio(F.col("n"), F.col("total"), 0.0) * 100, 2).alias("share_percent"))


def category_count(exceptions: DataFrame, bank: DataFrame, term: str) -> DataFrame:
    """Categories like ``term``; without any, reversals counted from the bank rows."""
    found = exceptions.filter(F.col("category").ilike(f"%{term}%")).groupBy("category").agg(
        F.count("*").alias("n"))
    fallback = bank.agg(
        F.count_if((F.col("net_amount") < 0) | F.col("description").ilike(f"%{term}%")).alias("n")
    ).withColumn("category", F.lit(None).cast("string"))
    any_found = found.agg((F.count("*") > 0).alias("any_found"))
    return found.unionByName(
        fallback.join(any_found, F.lit(True)).filter(~F.col("any_found")).select("category", "n"))


# --------------------------------------------------------------------- tax

def tax_line_audit(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Audit rows whose net credit or withheld tax is off."""
    e, net = F.col("expected_amount"), F.coalesce(F.col("net_amount"), F.lit(0))
    fee, tds = F.coalesce(F.col("fees_deducted"), F.lit(0)), F.coalesce(F.col("tax_deducted"), F.lit(0))
    contract = money.mdr_fee(e)
    expected_net = e - F.when(fee != 0, fee).otherwise(contract)
    tolerance = F.least(money.half_even(e * F.lit(0.001)), F.lit(1000))
    tds_off = (tds > 0) & (F.abs(tds - contract) > tolerance)
    rows = audited(matches, bank, ledger).filter(e > 0).withColumns({
        "expected_net": expected_net, "tolerance": tolerance, "tds_off": tds_off, "contract": contract})
    x, off = F.col("expected_net"), F.abs(net - F.col("expected_net"))
    rupees = lambda c: F.concat(F.lit("Rs "), money.inr_text(c))
    note = F.when(
        F.col("tds_off"),
        F.concat(F.lit(" TDS mismatch: Bank withheld "), rupees(tds), F.lit(" (Expected TDS: "),
                 rupees(F.col("contract")), F.lit(").")),
    ).otherwise("")
    return rows.filter((off > F.col("tolerance")) | F.col("tds_off")).select(
        F.col("settlement_id").alias("record_id"), "order_id", F.lit("bank_settlement").alias("source"),
        F.when(fee > F.col("contract") + F.col("tolerance"), "PLATFORM_FEE_OVERCHARGE")
        .when(F.col("tds_off"), "MISSING_TDS_WITHHOLDING").otherwise("TAX_LEAKAGE_MISMATCH").alias("category"),
        F.lit("HIGH").alias("priority"),
        F.concat(
            F.lit("Tax/Fee deduction shortfall on order "), F.col("order_id"), F.lit(": Bank net credit "),
            rupees(net), F.lit(" vs Expected "), rupees(x), F.lit(". Shortfall: "), rupees(off), F.lit("."), note,
        ).alias("reason"),
        F.concat(
            F.lit("Raise tax adjustment dispute with payment gateway for order "), F.col("order_id"),
            F.lit(" to recover "), rupees(off), F.lit(" tax leakage.")).alias("suggested_action"))


def tax_line_items(
    matches: DataFrame, bank: DataFrame, ledger: DataFrame, fee_percent: float = 2.0,
    gst_percent: float = 18.0, limit: int | None = None,
) -> DataFrame:
    """All audit rows (only the latest with a ``limit``) with fee and GST at the given rates."""
    rows = audited(matches, bank, ledger)
    if limit is not None:
        rows = rows.orderBy(
            F.desc("phase"), F.desc("date"), F.desc("settlement_id"), F.desc("order_id")).limit(limit)
    gross = F.coalesce(
        F.nullif(F.col("amount"), F.lit(0)), F.nullif(F.col("expected_amount"), F.lit(0)), F.lit(0))
    percent = lambda rate: money.inr(money.half_even(gross * F.lit(rate) / 100))
    tds = F.coalesce(F.col("tax_deducted"), F.lit(0))
    return rows.select(
        "settlement_id", "order_id", "customer_name", money.inr(gross).alias("gross_amount_inr"),
        percent(fee_percent).alias("platform_fee_inr"), percent(gst_percent).alias("gst_amount_inr"),
        money.inr(tds).alias("tds_withheld_inr"),
        money.inr(F.coalesce(F.col("net_amount"), F.lit(0))).alias("net_bank_credit_inr"),
        F.when(tds > 0, "TDS_2%_WITHHELD").otherwise("CLEAN_TAX_VERIFIED").alias("audit_status"))


def verified_tax_percent(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """T3, read from the tax audit itself."""
    total = audited(matches, bank, ledger).agg(F.count("*").alias("total_reconciled_matches"))
    leaks = tax_line_audit(matches, bank, ledger).agg(
        F.count_if(F.col("category") == "TAX_LEAKAGE_MISMATCH").alias("tax_leakage_mismatches_count"))
    n, bad = F.col("total_reconciled_matches"), F.col("tax_leakage_mismatches_count")
    return total.join(leaks, F.lit(True)).select(
        n, bad, F.bround(_ratio(n - bad, n) * 100, 1).alias("verified_tax_percent"))


# --------------------------------------------------------------------- customers and cash

def settlement_lags(matches: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Days from invoice to bank credit per audit row."""
    lag = F.greatest(F.lit(0), F.datediff("date", "invoice_date")).cast("double")
    return audited(matches, bank, ledger).filter("customer_name <> ''").select(
        "customer_name", "order_id", F.coalesce(lag, F.lit(fixed.DEFAULT_LAG_DAYS)).alias("lag_days"))


def open_orders(
    matches: DataFrame, ledger: DataFrame, exceptions: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """C2 per order: unmatched orders, whether overdue, and whether at risk."""
    flagged = exceptions.select(F.col("record_id").alias("order_id")).distinct().withColumn(
        "flagged", F.lit(True))
    # One column for the whole ledger; an order with a blank date is not overdue.
    due = F.col("expected_settlement_date" if "expected_settlement_date" in ledger.columns else "invoice_date")
    late = F.coalesce(due < _date(as_of), F.lit(False))
    return (
        ledger.join(matches.select("order_id").distinct(), "order_id", "left_anti")
        .join(flagged, "order_id", "left")
        .withColumns({
            "due": due, "is_overdue": late,
            "is_risk": late | F.coalesce("flagged", F.lit(False)),
            "late_days": F.when(late, F.greatest(F.lit(1), F.datediff(_date(as_of), due))).otherwise(0)})
        .drop("flagged")
    )


def customer_scores(
    matches: DataFrame, bank: DataFrame, ledger: DataFrame, exceptions: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Lag, violations, reliability score and badge per customer."""
    lags = settlement_lags(matches, bank, ledger).select("customer_name", "lag_days").withColumns({
        "is_open": F.lit(False), "expected_amount": F.lit(0).cast("long"), "is_risk": F.lit(False)})
    pending = open_orders(matches, ledger, exceptions, as_of).filter("customer_name <> ''")
    opened = pending.select(
        "customer_name", F.when(F.col("is_overdue"), F.col("late_days").cast("double")).alias("lag_days"),
        F.lit(True).alias("is_open"), "expected_amount", "is_risk")
    amount = F.coalesce("expected_amount", F.lit(0))
    per_customer = lags.unionByName(opened).groupBy("customer_name").agg(
        F.sum("lag_days").alias("lag_sum"), F.count("lag_days").alias("lag_count"),
        F.count_if("is_risk").alias("default_violations_count"),
        F.sum(F.when(F.col("is_open"), amount).otherwise(0)).alias("outstanding"),
        F.sum(F.when(F.col("is_risk"), amount).otherwise(0)).alias("at_risk"))
    # Only two reasons per customer are kept before they are collected.
    reason = F.when(
        F.col("is_overdue"),
        F.concat(F.lit("Order "), F.col("order_id"), F.lit(" overdue by "), F.col("late_days").cast("string"),
                 F.lit(" days")),
    ).otherwise(F.concat(F.lit("Order "), F.col("order_id"), F.lit(" flagged in discrepancy queue")))
    w = Window.partitionBy("customer_name").orderBy("ingest_seq", "order_id")
    first_two = (
        pending.filter("is_risk")
        .select("customer_name", "ingest_seq", "order_id", reason.alias("reason"))
        .withColumn("nth", F.row_number().over(w)).filter("nth <= 2")
        .groupBy("customer_name")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "reason"))).alias("reasons")))
    n = F.col("default_violations_count")
    avg_lag = F.when(F.col("lag_count") > 0, F.bround(F.col("lag_sum") / F.col("lag_count"), 1)).otherwise(
        F.lit(fixed.DEFAULT_LAG_DAYS))
    scored = per_customer.join(first_two, "customer_name", "left").withColumn("avg_lag_days", avg_lag)
    lag, score = F.col("avg_lag_days"), F.col("reliability_score_percent")
    scored = scored.withColumn(
        "reliability_score_percent",
        F.greatest(F.lit(0), F.least(F.lit(100), money.half_even(100 - lag * 4 - n * 20))).cast("long"))
    return scored.select(
        "customer_name", lag, n, score,
        F.when(n > 0, "REPEAT_DEFAULTER").when(score < 75, "CHRONIC_LAG").when(score >= 90, "HIGH_RELIABILITY")
        .otherwise("MODERATE_DELAY").alias("reliability_badge"),
        money.inr(F.col("outstanding")).alias("total_outstanding_inr"),
        money.inr(F.col("at_risk")).alias("at_risk_amount_inr"),
        F.when(
            n > 0,
            F.concat(
                n.cast("string"), F.lit(" Default Violation(s) recorded ("),
                F.array_join(F.transform("reasons", lambda r: r["reason"]), ", "), F.lit(")")))
        .when(lag > 5.0, F.concat(
            F.lit("Chronic settlement lag ("), lag.cast("decimal(10,1)").cast("string"), F.lit(" days late)")))
        .otherwise("All payments settled on-time").alias("default_reason_summary"))


def rank_customers(scores: DataFrame) -> DataFrame:
    """C4."""
    return scores.orderBy(F.desc("default_violations_count"), F.desc("at_risk_amount_inr"), "customer_name")


def collection_weights(matches: DataFrame, ledger: DataFrame) -> DataFrame:
    """C5."""
    n = matches.agg(F.count("*").alias("n"))
    total = ledger.agg(F.count("*").alias("total"))
    rate = F.bround(F.col("n") / F.greatest(F.lit(1), F.col("total")), 3)
    return n.join(total, F.lit(True)).select(
        F.greatest(F.lit(0.70), F.least(F.lit(0.95), rate)).alias("expected_collection_weight"),
        F.lit(fixed.AT_RISK_RECOVERY).alias("at_risk_recovery_weight"))


def confirmed_cash(
    matches: DataFrame, bank: DataFrame, ledger: DataFrame, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """All credits (only the latest with a ``limit``), and their sum in paise (all bank rows when that is zero)."""
    rows = audited(matches, bank, ledger)
    if limit is not None:
        rows = rows.orderBy(F.desc("date"), F.desc("settlement_id"), F.desc("order_id")).limit(limit)
    latest = rows.select(
        "order_id", "settlement_id", "customer_name", "date", "net_amount",
        money.inr(F.col("net_amount")).alias("amount_inr"), F.lit("CONFIRMED_CREDIT").alias("status"))
    recent = latest.agg(F.coalesce(F.sum("net_amount"), F.lit(0)).alias("recent"))
    everything = bank.agg(F.coalesce(F.sum("net_amount"), F.lit(0)).alias("everything"))
    total = recent.join(everything, F.lit(True)).select(
        F.when(F.col("recent") != 0, F.col("recent")).otherwise(F.col("everything")).alias("confirmed"))
    return latest.drop("net_amount"), total


def inflow_orders(
    matches: DataFrame, bank: DataFrame, ledger: DataFrame, exceptions: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """C7/C8 per open order: rupee value, shifted due date, days ahead, bucket and risk."""
    lags = customer_scores(matches, bank, ledger, exceptions, as_of).select("customer_name", "avg_lag_days")
    usd = F.upper(F.coalesce("currency", F.lit("INR"))) == "USD"
    amount = F.coalesce("expected_amount", F.lit(0))
    base = F.coalesce("due", F.date_add(_date(as_of), 7))
    lag = F.coalesce("avg_lag_days", F.lit(fixed.DEFAULT_LAG_DAYS))
    rows = open_orders(matches, ledger, exceptions, as_of).join(lags, "customer_name", "left").withColumns({
        "is_usd": usd,
        "inr_paise": F.when(usd, money.half_even(amount * F.lit(fixed.USD_INR_RATE))).otherwise(amount),
        "due_date": F.date_add(base, F.rint(lag).cast("int")),
    })
    ahead = F.datediff("due_date", _date(as_of))
    return rows.select(
        "order_id", F.coalesce("customer_name", F.lit("Unknown Customer")).alias("customer_name"),
        "expected_amount", "is_usd", "inr_paise", "due_date", ahead.alias("days_ahead"), "is_overdue", "is_risk",
        F.when(F.col("is_overdue"), "Overdue Payment Violation").when(F.col("is_risk"), "Exception Flagged")
        .alias("risk_reason"),
        F.when(ahead <= 7, "7D").when(ahead <= 14, "14D").otherwise("30D").alias("bucket"))


def cash_forecast(
    matches: DataFrame, bank: DataFrame, ledger: DataFrame, exceptions: DataFrame, as_of: dt.date | str,
    latest: int | None = None,
) -> DataFrame:
    """C6-C9 as one row; the confirmed cash is that of all credits, or of the ``latest`` ones."""
    orders = inflow_orders(matches, bank, ledger, exceptions, as_of)
    p, healthy = F.col("inr_paise"), ~F.col("is_risk")
    within = lambda days: F.coalesce(F.sum(F.when(healthy & (F.col("days_ahead") <= days), p)), F.lit(0))
    sums = orders.agg(
        within(7).alias("d7"), within(14).alias("d14"), within(30).alias("d30"),
        F.coalesce(F.sum(F.when(F.col("is_risk"), p)), F.lit(0)).alias("risk"),
        F.coalesce(F.sum(F.when(F.col("is_usd"), F.col("expected_amount"))), F.lit(0)).alias("usd"),
        F.coalesce(F.sum(F.when(F.col("is_usd"), p)), F.lit(0)).alias("usd_inr"),
        F.count_if(healthy).alias("healthy_pending_orders"),
        F.count_if("is_risk").alias("at_risk_pending_orders"))
    cash = confirmed_cash(matches, bank, ledger, latest)[1]
    row = sums.join(cash, F.lit(True)).join(collection_weights(matches, ledger), F.lit(True))
    best = F.col("confirmed") + F.col("d30") + F.col("risk")
    careful = F.col("confirmed") + money.half_even(
        F.col("d30") * F.col("expected_collection_weight") + F.col("risk") * F.col("at_risk_recovery_weight"))
    return row.select(
        money.inr(F.col("confirmed")).alias("confirmed_bank_cash_inr"),
        money.inr(F.col("d7")).alias("projected_7d_inflow_inr"),
        money.inr(F.col("d14")).alias("projected_14d_inflow_inr"),
        money.inr(F.col("d30")).alias("projected_30d_inflow_inr"),
        money.inr(F.col("risk")).alias("at_risk_receivables_30d_inr"),
        money.inr(F.col("usd")).alias("fx_receivables_usd"),
        money.inr(F.col("usd_inr")).alias("estimated_inr_value"),
        "expected_collection_weight", "at_risk_recovery_weight",
        money.inr(best).alias("best_case_30d_total_inr"),
        money.inr(careful).alias("conservative_30d_total_inr"),
        money.inr(best - careful).alias("uncertainty_margin_inr"),
        "healthy_pending_orders", "at_risk_pending_orders")


def stress(forecast: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The one forecast row under each (delay_days, recovery_percent) scenario."""
    inflow = F.greatest(
        F.lit(0.0), F.col("projected_30d_inflow_inr") * (1 - F.col("delay_days") * F.lit(0.02)))
    recovered = F.col("at_risk_receivables_30d_inr") * (F.col("recovery_percent") / 100)
    total = (
        F.col("confirmed_bank_cash_inr") + F.col("inflow") * F.col("expected_collection_weight")
        + F.col("recovered"))
    return (
        scenarios.join(forecast, F.lit(True))
        .withColumns({"inflow": inflow, "recovered": recovered})
        .select(
            "delay_days", "recovery_percent", F.round("inflow", 2).alias("simulated_30d_inflow_inr"),
            F.round("recovered", 2).alias("simulated_recovery_inr"),
            F.round(total, 2).alias("simulated_conservative_inr")))


# --------------------------------------------------------------------- review desk

# Feedback words.
APPROVALS, REJECTIONS = ("LIKE", "APPROVE", "APPROVED"), ("DISLIKE", "REJECT", "REJECTED")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """J5."""
    return feedback.groupBy("settlement_id").agg(F.max_by("feedback", "timestamp").alias("feedback"))


def sla_tags(matches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Q1."""
    fb, conf = F.col("feedback"), F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    rule = F.coalesce("rule_applied", F.lit(""))
    return matches.join(latest_feedback(feedback), "settlement_id", "left").select(
        "settlement_id", "order_id", "rule_applied", "confidence",
        F.when(fb.isin(*APPROVALS), "HUMAN_APPROVED").when(fb.isin(*REJECTIONS), "HUMAN_REJECTED")
        .when(rule.startswith("EXACT") | (conf >= 0.95), "MEETS_SLA").when(conf >= 0.85, "SLA_WARNING_24H")
        .otherwise("SLA_BREACH_48H").alias("sla_status"))


def newest_matches(matches: DataFrame) -> DataFrame:
    """W4."""
    return matches.orderBy(F.desc("phase"), F.desc("settlement_id"), F.desc("order_id"))


def by_priority(exceptions: DataFrame) -> DataFrame:
    """HIGH, MEDIUM, LOW."""
    weight = F.create_map(F.lit("HIGH"), F.lit(3), F.lit("MEDIUM"), F.lit(2), F.lit("LOW"), F.lit(1))
    return exceptions.orderBy(F.desc(weight[F.col("priority")]), "record_id")


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with ``term`` in any of the columns, ignoring case; the term is data, not a pattern."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.lower(F.lit(term)))
    return df.filter(hit)


def search_open_exceptions(exceptions: DataFrame, resolved: DataFrame, term: str) -> DataFrame:
    """Hides the records that are resolved."""
    return search(
        exceptions.join(resolved.select("record_id"), "record_id", "left_anti"), term,
        ["record_id", "category", "reason", "suggested_action"])


# --------------------------------------------------------------------- questions

def lookup_context(
    bank: DataFrame, matches: DataFrame, ledger: DataFrame, exceptions: DataFrame
) -> DataFrame:
    """A settlement with its match, order, exception and the discrepancy figures."""
    o = ledger.select(
        "order_id", "expected_amount", "customer_reference", "invoice_date", "expected_settlement_date",
        "customer_name", F.col("currency").alias("ledger_currency"), F.col("status").alias("ledger_status"))
    x = exceptions.select(
        F.col("record_id").alias("settlement_id"), F.col("category").alias("exception_category"),
        F.col("reason").alias("exception_reason"), F.col("suggested_action").alias("exception_suggested_action"))
    m = matches.select("settlement_id", "order_id", "rule_applied", "confidence")
    e = F.col("expected_amount")
    bank_ref = money.strip(F.coalesce("utr_reference", F.lit("")))
    order_ref = money.strip(F.coalesce("customer_reference", F.lit("")))
    present = (bank_ref != "") & (order_ref != "")
    same = present & (F.upper(bank_ref) == F.upper(order_ref))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    note = F.concat(
        F.lit("Bank reference "), quoted(bank_ref),
        F.when(same, F.lit(" and Ledger customer reference ")).otherwise(F.lit(" vs Ledger customer reference ")),
        quoted(order_ref),
        F.when(same, " match perfectly.").when(present, " — references differ.").otherwise("."))
    name = lambda c: F.lower(money.strip(F.coalesce(F.col(c), F.lit(""))))
    has_order = e.isNotNull()
    return (
        bank.drop("ingest_seq").join(m, "settlement_id", "left").join(o, "order_id", "left")
        .join(x, "settlement_id", "left")
        .withColumns({
            "reference_match": F.when(has_order, same),
            "reference_note": F.when(has_order, note),
            "customer_name_match": F.when(
                F.col("customer_name").isNotNull(), name("payer_account") == name("customer_name")),
            "gross_difference_inr": money.inr(F.col("amount") - e),
            "net_vs_expected_difference_inr": money.inr(F.col("net_amount") - money.one_step_net(e)),
        }))


def lookup_many(bank: DataFrame, ids: DataFrame) -> DataFrame:
    """Several settlements by id, the ids being a table."""
    return bank.join(ids.select("settlement_id").distinct(), "settlement_id", "left_semi")


def lookups(
    questions: DataFrame, bank: DataFrame, exceptions: DataFrame, ledger: DataFrame, gateway: DataFrame
) -> DataFrame:
    """(question_id, value) -> the records of the first source that knows the value.

    Values are joined as data, so no text of a question ever becomes a query.
    """
    q = questions.select("question_id", "value")

    def source(turn: int, name: str, df: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
        return df.select(
            F.lit(turn).alias("turn"), F.lit(name).alias("source"), F.col(id_column).alias("record_id"), F.explode(
                F.array_distinct(F.array_compact(F.array(*[F.col(k) for k in keys])))).alias("value"))

    # All sources meet the questions in one join, and what is found is written, as it is read twice.
    named = (
        source(1, "bank", bank, "settlement_id", ["settlement_id", "utr_reference"])
        .unionByName(source(2, "exception", exceptions, "record_id", ["record_id"]))
        .unionByName(source(3, "ledger", ledger, "order_id", ["order_id", "customer_reference"]))
        .unionByName(source(4, "gateway", gateway, "payout_id", ["payout_id", "order_id", "utr_reference"])))
    found = cut(q.join(named, "value").select("question_id", "turn", "source", "record_id").distinct(), "found")
    first = found.groupBy("question_id").agg(F.min("turn").alias("turn"))
    return found.join(first, ["question_id", "turn"]).select("question_id", "source", "record_id")


def general_summary(bank: DataFrame, ledger: DataFrame, matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """L2: one row of counts."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    row = (
        count(bank, "total_bank_settlements").join(count(ledger, "total_internal_orders"), F.lit(True))
        .join(count(matches, "reconciled_matches_count"), F.lit(True))
        .join(count(exceptions, "unresolved_exceptions_count"), F.lit(True)))
    m, t = F.col("reconciled_matches_count"), F.col("total_bank_settlements")
    return row.withColumn("match_rate_percent", F.bround(_ratio(m, t, 0.0) * 100, 2))


def summary_listing(summary: DataFrame, exceptions: DataFrame) -> DataFrame:
    """L2: every exception beside the counts of ``general_summary``; no exceptions give no rows."""
    listed = exceptions.select("record_id", "priority", "category")
    return listed.join(F.broadcast(summary), F.lit(True))  # the summary is one row


def summary_exceptions(exceptions: DataFrame) -> DataFrame:
    """By priority and category in alphabetical order."""
    return exceptions.select("record_id", "priority", "category", "reason", "suggested_action").orderBy(
        "priority", "category", "record_id")


def _inr(paise: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(money.inr(F.coalesce(paise, F.lit(0))), 2))


def answers(
    questions: DataFrame, context: DataFrame, summary: DataFrame, found: DataFrame, categories: DataFrame
) -> DataFrame:
    """L3: (question_id, question) -> answer text, for a whole table of questions.

    ``found`` is the number of records per question from ``lookups``;
    ``categories`` holds the E10 counts for reversals.
    """
    q = questions.select("question_id", "question", text.question_entity(F.col("question")).alias("e")).select(
        "question_id", "question", "e.filter_type", "e.value")
    one = context.groupBy("settlement_id").agg(F.min_by(F.struct(context.columns), "order_id").alias("c"))
    joined = q.join(
        one, (F.col("filter_type") == "settlement_id") & (F.col("value") == F.col("settlement_id")), "left"
    ).drop("settlement_id").join(
        found.groupBy("question_id").agg(F.count("*").alias("n_found")), "question_id", "left"
    ).join(summary, F.lit(True)).join(categories.agg(F.sum("n").alias("n_category")), F.lit(True))
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    parts = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("N/A")) for x in xs])
    c = F.col("c")
    money_line = parts(
        "Gross ", _inr(c["amount"]), ", net ", _inr(c["net_amount"]), ", fee ", _inr(c["fees_deducted"]))
    matched = parts(
        "Settlement ", tick(c["settlement_id"]), " reconciled to order ", tick(c["order_id"]), " by ",
        tick(c["rule_applied"]), " on ", c["date"].cast("string"), ". ", money_line, "; expected ",
        _inr(c["expected_amount"]), ".")
    unresolved = parts(
        "Settlement ", tick(c["settlement_id"]), " is unresolved: ", c["exception_category"], ". ", money_line,
        ". ", c["exception_reason"], " ", c["exception_suggested_action"])
    number = F.coalesce("n_found", F.lit(0))
    answer = (
        F.when(
            F.col("filter_type") == "general_query",
            parts(
                "Bank settlements: ", F.col("total_bank_settlements").cast("string"), ", matches: ",
                F.col("reconciled_matches_count").cast("string"), " (",
                F.col("match_rate_percent").cast("string"), "%), open exceptions: ",
                F.col("unresolved_exceptions_count").cast("string"), "."),
        )
        .when(
            F.col("filter_type") == "category_count",
            parts("Found ", F.coalesce("n_category", F.lit(0)).cast("string"), " record(s) matching '",
                  F.col("value"), "'."),
        )
        .when(c.isNotNull() & c["order_id"].isNotNull(), matched)
        .when(c.isNotNull(), unresolved)
        .when(number > 0, parts("Found ", number.cast("string"), " matching record(s) for '", F.col("value"), "'."))
        .otherwise(parts("No matching record was found for '", F.col("value"), "'."))
    )
    return joined.select("question_id", "filter_type", "value", answer.alias("answer"))
