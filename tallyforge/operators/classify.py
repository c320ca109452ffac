"""One category per unmatched record, first fitting rule first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import money

# Fixed value: how far a fee may exceed the contract fee, in paise.
FEE_SLACK = 500

OUT = ["record_id", "source", "category", "reason", "suggested_action", "priority", "is_exception"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rupees(paise: Column) -> Column:
    return F.concat(F.lit("₹"), money.inr_text(paise))


def _or_na(c: Column) -> Column:
    """Blank counts as missing, as an empty text does in a condition."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("N/A"))


def _verdict(category: str, priority: str, reason: Column, action: Column, is_exception: bool = True) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(priority).alias("priority"), reason.alias("reason"),
        action.alias("suggested_action"), F.lit(is_exception).alias("is_exception"))


def classify_bank(
    free: DataFrame,
    settled: DataFrame,
    top_candidate: DataFrame | None = None,
    pending: DataFrame | None = None,
) -> DataFrame:
    """Unmatched bank rows; ``settled`` is J2, ``top_candidate`` (settlement_id, order_id,
    expected_amount), ``pending`` (settlement_id, pending_reason)."""
    df = free.join(
        settled.select("utr_reference", F.lit(True).alias("is_settled")), "utr_reference", "left")
    if top_candidate is not None:
        df = df.join(
            top_candidate.select(
                "settlement_id", F.col("order_id").alias("cand_id"),
                F.col("expected_amount").alias("cand_expected")),
            "settlement_id", "left")
    else:
        df = df.withColumns({"cand_id": F.lit(None).cast("string"), "cand_expected": F.lit(None).cast("long")})
    if pending is not None:
        df = df.join(pending.select("settlement_id", "pending_reason"), "settlement_id", "left")
    else:
        df = df.withColumn("pending_reason", F.lit(None).cast("string"))

    rid, net, utr = F.col("settlement_id"), F.col("net_amount"), F.col("utr_reference")
    date, desc = _or_na(F.col("date")), F.coalesce(F.col("description"), F.lit(""))
    utr_or_blank, utr_na = F.coalesce(utr, F.lit("")), _or_na(utr)
    is_settled = F.coalesce(F.col("is_settled"), F.lit(False))
    cand, e = F.col("cand_id"), F.col("cand_expected")
    fee, tds = F.coalesce(F.col("fees_deducted"), F.lit(0)), F.coalesce(F.col("tax_deducted"), F.lit(0))
    contract_fee = money.mdr_fee(e)
    has_cand = cand.isNotNull()

    refers_back = is_settled | desc.contains("Chargeback") | F.lower(desc).contains("reversal")
    chargeback = _verdict(
        "CHARGEBACK_REVERSAL", "HIGH",
        _text(
            "Bank settlement ", rid, " on ", date, " has a negative amount of -", _rupees(F.abs(net)),
            " (UTR: '", utr_or_blank, "'), indicating a chargeback or reversal.",
            F.when(
                refers_back,
                _text(
                    " Transaction references previously settled UTR '",
                    F.coalesce(F.nullif(utr, F.lit("")), desc), "'."),
            ).otherwise(""),
        ),
        _text(
            "Debit merchant ledger account or file chargeback dispute with acquirer bank for UTR '",
            utr_or_blank, "'."))
    duplicate = _verdict(
        "DUPLICATE_SETTLEMENT", "HIGH",
        _text(
            "Bank settlement ", rid, " (", _rupees(net), ", UTR: '", utr, "', Date: ", date,
            ") is a duplicate entry for UTR '", utr, "' which was already reconciled to an existing order."),
        _text(
            "Flag settlement ", rid,
            " as duplicate entry and reverse duplicate credit in bank reconciliation journal."))
    overcharge = _verdict(
        "PLATFORM_FEE_OVERCHARGE", "HIGH",
        _text(
            "Platform fee overcharge detected on settlement ", rid, " (Order: ", cand, "). Deducted fee ",
            _rupees(fee), " exceeds 2.0% contract rate ", _rupees(contract_fee), "."),
        _text("File fee overcharge dispute with payment gateway to recover ", _rupees(fee - contract_fee), "."))
    withheld = _verdict(
        "MISSING_TDS_WITHHOLDING", "HIGH",
        _text(
            "Sec 194O TDS withholding mismatch on settlement ", rid, " (Order: ", cand, "). Bank tax withheld ",
            _rupees(tds), " vs expected ", _rupees(contract_fee), "."),
        _text("Issue revised TDS certificate / tax adjustment note to gateway for order ", cand, "."))
    unmapped = _verdict(
        "MISSING_BANK_CREDIT", "HIGH",
        _text(
            "Bank settlement ", rid, " on ", date, " (", _rupees(net), ") has unmapped UTR reference '", utr_na,
            "'."),
        _text("Contact gateway team to map orphan settlement ", rid, " to internal ERP order."))
    ambiguous = _verdict(
        "UNRESOLVED_AMBIGUOUS_DISCREPANCY", "MEDIUM",
        _text(
            "Bank settlement ", rid, " on ", date, " (net ", _rupees(net), ", UTR: '", utr_na,
            "') reference matches candidate order ", cand, " (expected ", _rupees(e), "), but amount differs by ",
            _rupees(F.abs(net - (e - contract_fee))), " (expected net after 2% fee ",
            _rupees(e - contract_fee), ")."),
        _text(
            "Review fee agreement or check for unrecorded partial refund/adjustment on order ", cand, "."))
    shown = F.coalesce(
        F.nullif(utr, F.lit("")), F.nullif(F.col("description"), F.lit("")), F.lit("N/A"))
    orphan = _verdict(
        "ORPHAN_BANK_SETTLEMENT", "MEDIUM",
        _text(
            "Bank settlement ", rid, " on ", date, " (net ", _rupees(net), ", UTR: '", shown, "', Payer: '",
            _or_na(F.col("payer_account")), "') has no matching candidate in internal ledger for reference '",
            shown, "' or amount ", _rupees(net), "."),
        _text(
            "Contact payment gateway team to verify if order entry for UTR '", shown,
            "' was omitted from internal ledger."))
    waiting = _verdict(
        "PENDING_VERIFICATION", "LOW", F.col("pending_reason"),
        F.lit("Awaiting AI verification capacity. Will resolve automatically on next run."), False)
    verdict = (
        F.when(F.col("pending_reason").isNotNull(), waiting)
        .when(net < 0, chargeback)
        .when((utr_or_blank != "") & is_settled, duplicate)
        .when(has_cand & (fee > contract_fee + FEE_SLACK), overcharge)
        .when(has_cand & (tds > 0), withheld)
        .when(has_cand & (utr_na.contains("ORPHAN") | utr_na.contains("MISSING")), unmapped)
        .when(has_cand, ambiguous)
        .otherwise(orphan)
    )
    return df.select(
        rid.alias("record_id"), F.lit("bank_settlement").alias("source"), verdict.alias("v")
    ).select("record_id", "source", "v.*").select(*OUT)


def classify_ledger(
    free: DataFrame, as_of: dt.date | str, top_candidate: DataFrame | None = None
) -> DataFrame:
    """Unmatched orders; ``top_candidate`` is (order_id, settlement_id, net_amount)."""
    if top_candidate is not None:
        df = free.join(
            top_candidate.select(
                "order_id", F.col("settlement_id").alias("cand_id"), F.col("net_amount").alias("cand_net")),
            "order_id", "left")
    else:
        df = free.withColumns({"cand_id": F.lit(None).cast("string"), "cand_net": F.lit(None).cast("long")})
    day = str(as_of)
    rid, e, due = F.col("order_id"), F.col("expected_amount"), F.col("expected_settlement_date")
    ref, made = _or_na(F.col("customer_reference")), _or_na(F.col("invoice_date"))
    pending = _verdict(
        "PENDING_SETTLEMENT", "LOW",
        _text(
            "Internal order ", rid, " (", _rupees(e), ", Ref: '", ref, "') expected settlement date (",
            due.cast("string"), f") is in the future relative to batch date ({day})."),
        _text(
            "No action required for order ", rid, ". Awaiting expected settlement window (", due.cast("string"),
            ")."),
        False)
    ambiguous = _verdict(
        "UNRESOLVED_AMBIGUOUS_DISCREPANCY", "MEDIUM",
        _text(
            "Internal order ", rid, " on ", made, " (", _rupees(e), ", Ref: '", ref,
            "') partially matches candidate settlement ", F.col("cand_id"), " (net ", _rupees(F.col("cand_net")),
            "), but net amount differs by ", _rupees(F.abs(e - F.col("cand_net"))), "."),
        _text(
            "Verify if candidate settlement ", F.col("cand_id"),
            " included unauthorized fee deductions or partial payment."))
    orphan = _verdict(
        "ORPHAN_LEDGER_ORDER", "MEDIUM",
        _text(
            "Internal order ", rid, " created on ", made, " (expected ", _rupees(e), ", Customer: '",
            _or_na(F.col("customer_name")), "', Ref: '", ref,
            "') has no matching bank settlement for reference '", ref, "' or amount ", _rupees(e), "."),
        _text(
            "Verify if customer payment for order ", rid,
            " failed, was refunded, or was settled under an alternate UTR."))
    verdict = (
        F.when(due > F.lit(day).cast("date"), pending)
        .when(F.col("cand_id").isNotNull(), ambiguous)
        .otherwise(orphan)
    )
    return df.select(
        rid.alias("record_id"), F.lit("internal_ledger").alias("source"), verdict.alias("v")
    ).select("record_id", "source", "v.*").select(*OUT)
