"""The given tables and the reconciliation tables that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import money
from tallyforge.session import cut, spread

_written: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table, written on first use and read by every later query of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = cut(make(), name)
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, joined once for all derived tables."""
    return once(spark, sf_dir, "orders", lambda: _derive_orders(spark, sf_dir))


def _derive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        spread(table(spark, sf_dir, "orders"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "o_custkey",
            F.col("c_name").alias("customer_name"),
            F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("long").alias("e"),
            F.to_date("o_orderdate").alias("invoice_date"),
            F.date_add(F.to_date("o_orderdate"), 2).alias("due"),
            F.when(F.col("o_orderkey") % 50 == 0, "USD").otherwise("INR").alias("currency"),
            (F.col("o_custkey") % 10 == 0).alias("is_split"),
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "ledger", lambda: derive_ledger(spark, sf_dir))


def derive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger order per row of ``orders``."""
    return _orders(spark, sf_dir).select(
        _code("ORD", F.col("o_orderkey")).alias("order_id"),
        "invoice_date",
        F.col("e").alias("expected_amount"),
        "customer_name",
        F.when(~F.col("is_split"), _code("REF", F.col("o_orderkey"))).alias("customer_reference"),
        F.col("due").alias("expected_settlement_date"),
        money.half_even(F.col("e") * F.lit(0.18)).alias("tax_amount"),
        "currency",
        F.lit("unsettled").alias("status"),
        F.col("o_orderkey").alias("ingest_seq"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "bank", lambda: derive_bank(spark, sf_dir))


def derive_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows: per order the kinds listed below, and one row per split customer."""
    orders = _orders(spark, sf_dir)
    k = F.col("o_orderkey") % 20
    e, due, ref = F.col("e"), F.col("due"), _code("REF", F.col("o_orderkey"))
    plain = F.lit("Payout credit")

    def row(net, fees=F.lit(0), utr=ref, date=due, text=plain, prefix="STL") -> Column:
        return F.struct(
            _code(prefix, F.col("o_orderkey")).alias("settlement_id"),
            date.alias("date"),
            net.cast("long").alias("net_amount"),
            fees.cast("long").alias("fees_deducted"),
            utr.cast("string").alias("utr_reference"),
            text.alias("description"),
        )

    net2 = money.two_step_net(e)
    fee3 = money.half_even(e * F.lit(0.03))
    half, tenth = (e - e % 2) / 2, (e - e % 10) / 10
    three_tenths, two_tenths = (e * 3 - (e * 3) % 10) / 10, (e * 2 - (e * 2) % 10) / 10
    rows = (
        F.when(k <= 2, F.array(row(e)))
        .when(k == 3, F.array(row(e, text=F.concat(F.lit("Credit for "), _code("ORD", F.col("o_orderkey"))))))
        .when(k == 4, F.array(row(e, text=F.concat(F.lit("Payout "), _code("PAYOUT", F.col("o_orderkey"))))))
        .when(k == 5, F.array(row(e, utr=F.lit(None), text=F.concat(F.lit("Settlement for "), ref))))
        .when(k <= 9, F.array(row(net2, fees=e - net2)))
        .when(k == 10, F.array(row(e - fee3, fees=fee3)))
        .when(k == 11, F.array(row(e + 400)))
        .when(k == 12, F.array(row(e + 501)))
        .when(k == 13, F.array(row(e, date=F.date_add(due, 10))))
        .when(k == 14, F.array(row(half), row(e - half, prefix="STX")))
        .when(k == 15, F.array(row(three_tenths), row(two_tenths, prefix="STX")))
        .when(k == 16, F.array(row(e, utr=F.concat(F.lit("REF"), F.col("o_orderkey").cast("string")))))
        .when(k == 17, F.array(row(e), row(-tenth, text=F.lit("Chargeback reversal"), prefix="STX")))
        .when(k == 18, F.array(row(e), row(e, date=F.date_add(due, 1), prefix="STX")))
        .otherwise(F.filter(F.array(row(e)), lambda r: F.lit(False)))
    )
    single = (
        orders.filter(~F.col("is_split"))
        .select("o_orderkey", "o_custkey", "currency", F.inline(rows))
        .select(
            "settlement_id",
            "date",
            "net_amount",
            "fees_deducted",
            "utr_reference",
            F.concat(F.lit("ACC"), F.col("o_custkey").cast("string")).alias("payer_account"),
            "description",
            "currency",
            F.col("o_orderkey").alias("ingest_seq"),
        )
    )
    split = (
        orders.filter("is_split")
        .groupBy("o_custkey", "customer_name")
        .agg(F.sum("e").alias("net_amount"), F.max("due").alias("date"))
        .select(
            _code("STC", F.col("o_custkey")).alias("settlement_id"),
            "date",
            "net_amount",
            F.lit(0).cast("long").alias("fees_deducted"),
            F.lit(None).cast("string").alias("utr_reference"),
            F.col("customer_name").alias("payer_account"),
            plain.alias("description"),
            F.lit("INR").alias("currency"),
            F.col("o_custkey").alias("ingest_seq"),
        )
    )
    return single.unionByName(split).select(
        "settlement_id",
        "date",
        (F.col("net_amount") + F.col("fees_deducted")).alias("amount"),
        "utr_reference",
        "payer_account",
        "fees_deducted",
        F.lit(0).cast("long").alias("tax_deducted"),
        "net_amount",
        "description",
        "currency",
        "ingest_seq",
    )


def gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "gateway", lambda: derive_gateway(spark, sf_dir))


def derive_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payout per seventh order of a customer who is not settled in one sum."""
    e = F.col("e")
    return (
        _orders(spark, sf_dir)
        .filter(~F.col("is_split") & (F.col("o_orderkey") % 7 == 0))
        .select(
            _code("PAYOUT", F.col("o_orderkey")).alias("payout_id"),
            F.col("due").alias("payout_date"),
            _code("ORD", F.col("o_orderkey")).alias("order_id"),
            _code("REF", F.col("o_orderkey")).alias("utr_reference"),
            e.alias("gross_amount"),
            money.mdr_fee(e).alias("gateway_fee"),
            money.gst_on_fee(e).alias("gateway_tax"),
            money.two_step_net(e).alias("net_payout"),
            F.lit("SETTLED").alias("status"),
            F.col("o_orderkey").alias("ingest_seq"),
        )
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "ground_truth", lambda: derive_ground_truth(spark, sf_dir))


def derive_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intended pair of every bank row; the k = 12 pairs are listed as false."""
    k = F.col("o_orderkey") % 20
    order_id = _code("ORD", F.col("o_orderkey"))

    def pair(prefix: str, truth: Column | bool = True) -> Column:
        flag = truth if isinstance(truth, Column) else F.lit(truth)
        return F.struct(
            _code(prefix, F.col("o_orderkey")).alias("settlement_id"), flag.alias("is_true_match")
        )

    orders = _orders(spark, sf_dir)
    singles = orders.filter(~F.col("is_split") & (k != 19)).select(
        order_id.alias("order_id"),
        F.inline(
            F.when(k.isin(14, 15), F.array(pair("STL"), pair("STX"))).otherwise(
                F.array(pair("STL", k != 12))
            )
        ),
    )
    split = orders.filter("is_split").select(
        order_id.alias("order_id"),
        _code("STC", F.col("o_custkey")).alias("settlement_id"),
        F.lit(True).alias("is_true_match"),
    )
    return singles.select("settlement_id", "order_id", "is_true_match").unionByName(
        split.select("settlement_id", "order_id", "is_true_match")
    )
