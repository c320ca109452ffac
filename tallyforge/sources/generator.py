"""Seeded three-source batches of any size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import money

# Shares of a generated batch, out of 71 rows each.
MATCHED, PENDING, OVERDUE, FAULTY = 55, 8, 5, 3
UNIT = MATCHED + PENDING + OVERDUE + FAULTY


def _draw(seed: int, name: str, low: int, high: int) -> Column:
    """A whole number in [low, high] that depends on the row and the seed only."""
    return (F.pmod(F.xxhash64("i", F.lit(name), F.lit(seed)), F.lit(high - low + 1)) + low).cast("long")


def generate(spark: SparkSession, units: int, seed: int = 42, start: dt.date = dt.date(2026, 7, 1)):
    """(bank, ledger, gateway) with 55 matched, 8 pending, 5 overdue orders and 3 faulty bank rows per unit."""
    rows = spark.range(units * UNIT).withColumnRenamed("id", "i").withColumn("p", F.col("i") % UNIT)
    kind = (
        F.when(F.col("p") < MATCHED, "matched").when(F.col("p") < MATCHED + PENDING, "pending")
        .when(F.col("p") < MATCHED + PENDING + OVERDUE, "overdue").otherwise("faulty"))
    code = lambda prefix: F.concat(F.lit(prefix), F.lpad(F.col("i").cast("string"), 12, "0"))
    day = F.lit(start.isoformat()).cast("date")
    gross = _draw(seed, "gross", 100, 1500) * 100_000
    rows = rows.withColumn("kind", kind).withColumn("gross", gross).withColumns({
        "fee": money.mdr_fee(F.col("gross")),
        "invoiced": F.when(F.col("kind") == "overdue", F.date_sub(day, 20)).otherwise(
            F.date_add(day, _draw(seed, "day", 0, 20).cast("int"))),
        "lag": _draw(seed, "lag", 1, 15).cast("int"),
        "company": F.concat(F.lit("Company "), _draw(seed, "company", 0, 999).cast("string")),
    }).withColumn("due", F.date_add("invoiced", F.col("lag")))
    in_bank = rows.filter("kind in ('matched', 'faulty')")
    fault = F.col("p") - (MATCHED + PENDING + OVERDUE)
    net = F.when((F.col("kind") == "faulty") & (fault == 0), -F.col("gross")).otherwise(F.col("gross") - F.col("fee"))
    bank = in_bank.select(
        code("STL").alias("settlement_id"), F.col("due").alias("date"), F.col("gross").alias("amount"),
        F.when((F.col("kind") == "faulty") & (fault == 2), code("MISC")).when(
            (F.col("kind") == "faulty") & (fault == 1),
            F.concat(F.lit("REF"), F.lpad((F.col("i") - UNIT + 1 + F.lit(MATCHED)).cast("string"), 12, "0")),
        ).otherwise(code("REF")).alias("utr_reference"),
        F.concat(F.lit("ACC_"), F.col("company")).alias("payer_account"), F.col("fee").alias("fees_deducted"),
        F.lit(0).cast("long").alias("tax_deducted"), net.alias("net_amount"),
        F.concat(F.lit("Settlement from "), F.col("company")).alias("description"),
        F.lit("INR").alias("currency"), F.col("i").alias("ingest_seq"))
    ledger = rows.filter("kind <> 'faulty'").select(
        code("ORD").alias("order_id"), F.col("invoiced").alias("invoice_date"),
        F.col("gross").alias("expected_amount"), F.col("company").alias("customer_name"),
        code("REF").alias("customer_reference"), F.col("due").alias("expected_settlement_date"),
        money.half_even(F.col("gross") * F.lit(0.18)).alias("tax_amount"), F.lit("INR").alias("currency"),
        F.when(F.col("kind") == "matched", "settled").otherwise("unsettled").alias("status"),
        F.col("i").alias("ingest_seq"))
    gateway = rows.filter("kind = 'matched'").select(
        code("PAYOUT").alias("payout_id"), F.col("due").alias("payout_date"), code("ORD").alias("order_id"),
        code("REF").alias("utr_reference"), F.col("gross").alias("gross_amount"),
        F.col("fee").alias("gateway_fee"), money.half_even(F.col("fee") * F.lit(0.18)).alias("gateway_tax"),
        (F.col("gross") - F.col("fee")).alias("net_payout"), F.lit("SETTLED").alias("status"),
        F.col("i").alias("ingest_seq"))
    return bank, ledger, gateway
