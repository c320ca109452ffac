"""Validated CSV ingestion with reject reports and upsert by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import money
from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut
from tallyforge.sources.records import CORRUPT, read_csv


@dataclass(frozen=True)
class Contract:
    """A validated record: the id, and how each column is read."""

    key: str
    columns: tuple[tuple[str, str], ...]  # (name, kind)

    def kind(self, name: str) -> str:
        return dict(self.columns)[name]


# The columns of the three inputs. Kinds: text, ref (blank is
# NULL), date, money, tax (blank or absent is 0).
BANK = Contract("settlement_id", (
    ("settlement_id", "text"), ("date", "date"), ("amount", "money"), ("utr_reference", "ref"),
    ("payer_account", "text"), ("fees_deducted", "money"), ("tax_deducted", "tax"),
    ("net_amount", "money"), ("description", "text"), ("currency", "text"),
))
LEDGER = Contract("order_id", (
    ("order_id", "text"), ("invoice_date", "date"), ("expected_amount", "money"), ("customer_name", "text"),
    ("customer_reference", "ref"), ("expected_settlement_date", "date"), ("tax_amount", "money"),
    ("currency", "text"), ("status", "text"),
))
OPTIONAL_KINDS = ("ref", "tax")


def _read_value(c: Column, kind: str) -> Column:
    if kind == "date":
        return money.parse_date(c)
    if kind == "money":
        return money.amount_to_paise(c)
    if kind == "tax":
        return money.tax_to_paise(c)
    return money.blank_to_null(c) if kind == "ref" else F.coalesce(c, F.lit(""))


def _complaint(c: Column, value: Column, name: str, kind: str) -> Column:
    """Why a column is rejected, as 'field: message'; NULL when it is fine."""
    blank = money.blank_to_null(c).isNull()
    if kind in ("text", "ref"):
        return F.lit(None).cast("string")
    what = "Date" if kind == "date" else "Amount"
    bad = F.concat(F.lit(f"{name}: Value error, Invalid {what.lower()} format: "), c)
    empty = F.lit(f"{name}: Value error, {what} cannot be null or empty")
    wrong = value.isNull()
    return F.when(wrong & blank, empty).when(wrong, bad)


def check(raw: DataFrame, contract: Contract, keep: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Typed columns plus ``errors`` and those of ``keep``; one narrow projection over the raw text."""
    present = set(raw.columns)
    out, errors = [], []
    for name, kind in contract.columns:
        if name not in present:
            if kind in OPTIONAL_KINDS:
                out.append((F.lit(0).cast("long") if kind == "tax" else F.lit(None).cast("string")).alias(name))
            else:
                out.append(F.lit(None).cast("string").alias(name))
                errors.append(F.lit(f"{name}: Field required"))
            continue
        value = _read_value(F.col(name), kind)
        out.append(value.alias(name))
        errors.append(_complaint(F.col(name), value, name, kind))
    if CORRUPT in present:
        last = raw.columns[raw.columns.index(CORRUPT) - 1]
        errors.append(
            F.when(F.col(CORRUPT).isNotNull() & F.col(last).isNull(), F.lit("row: Field required")))
    return raw.select(
        *out, F.col("ingest_seq"), F.array_compact(F.array(*errors)).alias("errors"),
        *[c for c in keep if c in present])


@dataclass
class Ingested:
    rows: DataFrame
    stats: DataFrame  # total, valid, invalid, duplicates


def ingest(raw: DataFrame, contract: Contract) -> Ingested:
    """S1/S2. Drop exact repeats of a row, validate, keep the first valid row per id.

    Repeats and ids are found by map-side combined aggregates, so an id or row
    that fills a third of the file is reduced before it is shuffled.
    """
    data = [c for c in raw.columns if c not in (CORRUPT, "source_file", "ingest_seq")]
    corrupt = [CORRUPT] if CORRUPT in raw.columns else []
    trimmed = [money.strip(F.coalesce(F.col(c), F.lit("None"))).alias(f"_t_{c}") for c in data]
    distinct = (
        raw.select("*", *trimmed)
        .groupBy(*[f"_t_{c}" for c in data])
        .agg(F.min_by(F.struct(*data, *corrupt, "ingest_seq"), "ingest_seq").alias("first"),
             F.count("*").alias("copies"))
        .select("first.*", "copies")
    )
    checked = cut(check(distinct, contract, keep=("copies",)), "checked")
    valid = checked.filter(F.size("errors") == 0)
    names = [n for n, _ in contract.columns]
    rows = valid.groupBy(contract.key).agg(
        F.min_by(F.struct(*[n for n in names if n != contract.key], "ingest_seq"), "ingest_seq").alias("r")
    ).select(contract.key, "r.*").select(*names, "ingest_seq")
    totals = checked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count("*").alias("distinct_rows"),
    )
    kept = rows.agg(F.count("*").alias("valid"))
    stats = totals.join(kept, F.lit(True)).select(
        "total", "valid", (F.col("distinct_rows") - F.col("valid")).alias("invalid"), "duplicates")
    return Ingested(rows, stats)


def ingest_gateway(raw: DataFrame) -> Ingested:
    """S3. No repeat detection; defaults only for absent columns; last row per payout wins."""
    have = set(raw.columns)

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else default

    def paise(name: str, default: Column) -> Column:
        return money.amount_to_paise(F.col(name)) if name in have else default

    zero = F.lit(0).cast("long")
    numbered = raw
    if "payout_id" not in have:
        numbered = with_rank(raw.withColumn("_all", F.lit(0)), ["_all"], ["ingest_seq"], "_n")
    gross, fee = paise("gross_amount", zero), paise("gateway_fee", zero)
    typed = numbered.select(
        money.strip(
            col("payout_id", F.concat(F.lit("PAYOUT_"), F.col("_n").cast("string")) if "payout_id" not in have
                else F.lit(""))).alias("payout_id"),
        (money.parse_date(F.col("payout_date")) if "payout_date" in have
         else F.lit("2026-07-01").cast("date")).alias("payout_date"),
        money.strip(col("order_id", F.lit(""))).alias("order_id"),
        money.strip(col("utr_reference", F.lit(""))).alias("utr_reference"),
        gross.alias("gross_amount"), fee.alias("gateway_fee"), paise("gateway_tax", zero).alias("gateway_tax"),
        paise("net_payout", gross - fee).alias("net_payout"),
        money.strip(col("status", F.lit("SETTLED"))).alias("status"),
        "ingest_seq",
    )
    ok = F.lit(True)
    for c in ("payout_date", "gross_amount", "gateway_fee", "gateway_tax", "net_payout"):
        ok = ok & F.col(c).isNotNull()
    rows = latest_by_key(typed.filter(ok), "payout_id", "ingest_seq")
    stats = typed.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"))
    return Ingested(rows, stats)


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(
        *rows.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """S6. Rows of the newer load replace older ones with the same key."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    return latest_by_key(both, key, "_load").drop("_load")


def validation_report(raw: DataFrame, contract: Contract) -> DataFrame:
    """S5. One message per rejected row; line numbers count the header as line 1."""
    data = [c for c in raw.columns if c not in (CORRUPT, "source_file", "ingest_seq")]
    filled = F.lit(False)
    for c in data:
        filled = filled | (F.coalesce(F.col(c), F.lit("")) != "")
    group = "source_file" if "source_file" in raw.columns else None
    numbered = raw if group else raw.withColumn("source_file", F.lit(""))
    numbered = with_rank(numbered, ["source_file"], ["ingest_seq"], "_n")
    checked = check(numbered.filter(filled), contract)
    lines = numbered.select("ingest_seq", (F.col("_n") + 1).alias("line"))
    bad = checked.filter(F.size("errors") > 0).join(lines, "ingest_seq")
    return bad.select(
        "line", F.col(contract.key).alias("record_id"),
        F.concat(
            F.lit("Row "), F.col("line").cast("string"), F.lit(" (ID: "), F.col(contract.key), F.lit("): "),
            F.array_join("errors", "; ")).alias("message"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """S4. Every listed row with its flag; ``last_flags`` keeps the last per pair."""
    raw = read_csv(spark, path)
    return raw.select(
        F.coalesce("settlement_id", F.lit("")).alias("settlement_id"),
        F.coalesce("order_id", F.lit("")).alias("order_id"),
        (F.lower(money.strip(F.coalesce("is_true_match", F.lit("")))) == "true").alias("is_true_match"),
        "ingest_seq",
    ).filter("settlement_id <> '' and order_id <> ''")


def last_flags(truth: DataFrame) -> DataFrame:
    return truth.groupBy("settlement_id", "order_id").agg(
        F.max_by("is_true_match", "ingest_seq").alias("is_true_match"))
