"""The tables a batch leaves behind, as partitioned parquet in one folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.functions import money
from tallyforge.settings import RULE_MANUAL

# The tables a snapshot holds, and how many snapshots are kept.
SNAPSHOT_TABLES = (
    "bank_settlements", "internal_ledger", "gateway_settlements", "audit_log", "exceptions",
    "pending_verifications", "human_feedback", "exception_comments",
)
SNAPSHOTS_KEPT = 10


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Store:
    """Tables under ``root``; batch tables are partitioned by ``batch_id``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame | None:
        path = self._path(name)
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    # S7
    def append_audit(self, matches: DataFrame, batch_id: str, logged_at: dt.datetime, json_lines: bool = False):
        """Append the matches of a run; the run time is a parameter, so a retry writes the same rows."""
        rows = matches.withColumns(
            {"batch_id": F.lit(batch_id), "timestamp": F.lit(logged_at).cast("timestamp")})
        rows.write.mode("append").partitionBy("batch_id").parquet(self._path("audit_log"))
        if json_lines:
            rows.write.mode("append").json(self._path("audit_log_json"))

    # S8
    def replace_batch(self, name: str, rows: DataFrame, batch_id: str):
        """Overwrite one batch of ``name`` and leave the other batches alone."""
        (
            rows.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(self._path(name))
        )

    # S14
    def append_feedback(self, rows: DataFrame):
        rows.write.mode("append").parquet(self._path("human_feedback"))

    def append_comments(self, rows: DataFrame):
        rows.write.mode("append").parquet(self._path("exception_comments"))

    def comments(self, record_id: str) -> DataFrame:
        return comments_of(self.read("exception_comments"), record_id)

    # S10 - S12
    def save_snapshot(self, snapshot_id: str, name: str, saved_at: dt.datetime, tables: dict[str, DataFrame]):
        """Write the given tables under the snapshot, then its manifest row, last."""
        for table, df in tables.items():
            if table not in SNAPSHOT_TABLES:
                raise ValueError(f"unknown snapshot table {table}")
            df.write.mode("overwrite").parquet(self._path(f"snapshots/{snapshot_id}/{table}"))
        count = lambda t: tables[t].count() if t in tables else 0
        manifest = self.spark.createDataFrame(
            [(snapshot_id, name, saved_at, count("bank_settlements"), count("audit_log"), count("exceptions"),
              sorted(tables))],
            "id string, batch_name string, saved_at timestamp, total_records long, matched_count long, "
            "exceptions_count long, tables array<string>")
        manifest.coalesce(1).write.mode("append").parquet(self._path("manifest"))

    def delete_snapshot(self, snapshot_id: str):
        rows = self.spark.createDataFrame([(snapshot_id,)], "id string")
        rows.coalesce(1).write.mode("append").parquet(self._path("manifest_deleted"))

    def snapshots(self) -> DataFrame | None:
        """What is kept, newest first: the newest ten that were not deleted."""
        manifest = self.read("manifest")
        if manifest is None:
            return None
        deleted = self.read("manifest_deleted")
        if deleted is not None:
            manifest = manifest.join(deleted, "id", "left_anti")
        return kept_snapshots(manifest)

    def restore_snapshot(self, snapshot_id: str | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, or of the latest one."""
        kept = self.snapshots()
        if kept is None:
            return {}
        if snapshot_id is not None:
            kept = kept.filter(F.col("id") == snapshot_id)
        row = kept.first()
        if row is None:
            return {}
        return {t: self.spark.read.parquet(self._path(f"snapshots/{row.id}/{t}")) for t in row.tables}


def restore_into(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved rows in the shape of the current table; columns on one side only are NULL or dropped."""
    return saved.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in saved.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in current.schema
    ])


def kept_snapshots(manifest: DataFrame, keep: int = SNAPSHOTS_KEPT) -> DataFrame:
    """W7."""
    return manifest.orderBy(F.desc("saved_at"), F.desc("id")).limit(keep)


def comments_of(comments: DataFrame, record_id: str) -> DataFrame:
    return comments.filter(F.col("record_id") == record_id).orderBy(F.desc("timestamp"))


def latest_complete_batch(files: DataFrame, required: list[str]) -> DataFrame:
    """(batch_id, file_name) -> the newest batch that has every required file."""
    return (
        files.filter(F.col("file_name").isin(*required))
        .groupBy("batch_id")
        .agg(F.countDistinct("file_name").alias("n"))
        .filter(F.col("n") == len(required))
        .agg(F.max("batch_id").alias("batch_id"))
    )


def apply_rematches(
    matches: DataFrame, exceptions: DataFrame, overrides: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settlement_id, order_id, analyst_name, timestamp) -> new matches, exceptions, feedback."""
    manual = overrides.select(
        "settlement_id", "order_id", F.lit(RULE_MANUAL).alias("rule_applied"), F.lit(1.0).alias("confidence"),
        F.lit(10).alias("phase"), F.lit("matched").alias("status"))
    left = exceptions.join(
        overrides.select(F.col("settlement_id").alias("record_id")), "record_id", "left_anti")
    feedback = overrides.select(
        "settlement_id", "order_id", F.lit("MANUAL_REMATCH_APPROVED").alias("feedback"), "timestamp")
    return matches.unionByName(manual, allowMissingColumns=True), left, feedback


def gst_export(tax_items: DataFrame) -> DataFrame:
    """The nine columns of the filing export, under their printed names."""
    # Export headings.
    names = {
        "order_id": "Order ID", "settlement_id": "Settlement ID", "customer_name": "Customer Name",
        "gross_amount_inr": "Gross Invoice INR", "platform_fee_inr": "Platform Fee INR",
        "gst_amount_inr": "GST Amount INR", "tds_withheld_inr": "TDS Sec 194O INR",
        "net_bank_credit_inr": "Net Credit INR", "audit_status": "Audit Status",
    }
    return tax_items.select(*[F.col(c).alias(n) for c, n in names.items()])


def journal_lines(matches: DataFrame, bank: DataFrame) -> DataFrame:
    """Three journal lines per matched settlement: bank and fee debits against the receivable."""
    gross = F.col("amount")
    fee = money.one_step_fee(gross)
    line = lambda n, side, account, amount: F.struct(
        F.lit(n).alias("line"), F.lit(side).alias("side"), F.lit(account).alias("account"),
        amount.alias("amount_paise"))
    settled = bank.join(matches.select("settlement_id").distinct(), "settlement_id", "left_semi")
    return settled.select(
        "settlement_id", F.col("utr_reference"),
        F.inline(F.array(
            line(1, "DEBIT", "Bank Nodal Account", gross - fee),
            line(2, "DEBIT", "Payment Gateway Fee Account", fee),
            line(3, "CREDIT", "Customer Order Receivable", gross),
        )))


def receipt(gross: Column) -> Column:
    """Gross, 2.36 % fee and 97.64 % net, each to two decimals."""
    g = gross.cast("decimal(18,2)")
    rate = lambda r: F.bround((g * F.lit(r).cast("decimal(6,4)")), 2).cast("decimal(18,2)")
    return F.struct(g.alias("gross"), rate("0.0236").alias("fee"), rate("0.9764").alias("net"))
