"""Sources, windows, state, joins and sinks of the streaming form.

Every flow runs with ``availableNow`` in tests and queries; a service would
start the same flows with a processing-time trigger. Greedy matching sees
settlements in arrival order, micro-batch by micro-batch, so it equals the
batch result when they arrive in (date, settlement_id) order or when no two
settlements compete for one order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge.functions import text
from tallyforge.operators import matchers
from tallyforge.operators.skewjoin import broadcast_if_small
from tallyforge.session import cut, new_path
from tallyforge.settings import Settings
from tallyforge.sources.store import path_exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --------------------------------------------------------------------- sources and sinks

def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """R1. A drop folder as a stream; the schema is required."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """R3."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available to a parquet folder, exactly once."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return query


def run_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Hand every micro-batch and its number to ``write``."""
    query = (
        df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def idempotent_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A batch rewritten after a failure replaces its own folder, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def collect_stream(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a flow over what is available and return what it wrote."""
    spark = df.sparkSession
    out, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    if mode == "append":
        run_to_files(df, out, checkpoint)
        return spark.read.schema(df.schema).parquet(out)
    run_batches(df, idempotent_writer(out), checkpoint, mode)
    return spark.read.option("basePath", out).parquet(out)


def progress(query: StreamingQuery) -> list[dict[str, Any]]:
    """Batch number and input rows of every finished trigger."""
    return [{"batch_id": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]


# --------------------------------------------------------------------- windows and state

def windowed_totals(events: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """R5-R7. Count and total per window and type; rows later than ``delay`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("cents").alias("cents")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "cents")


def user_sessions(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """R8."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def running_totals(events: DataFrame) -> DataFrame:
    """R9. Totals per user, for update or complete mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """R10."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


#: References are dealt to so many states. A call to the state store costs as much as many rows, so it serves many references.
BUCKETS = 1024


class PartialGroupState(StatefulProcessor):
    """R11. Count and total per reference; a reference is reported when its group can no longer grow.

    The state of a reference is its count, its total and the time until which it
    may grow, however many settlements it has. The references of a bucket share
    one entry and one timer, that of the first of them to be reported.
    """

    def __init__(self, wait_ms: int):
        self._wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._groups = handle.getValueState("groups", "ref array<string>, n array<long>, total array<long>, until array<long>")

    def _held(self) -> pd.DataFrame:
        held = self._groups.get() if self._groups.exists() else ([], [], [], [])
        return pd.DataFrame({"ref": pd.Series(list(held[0]), dtype=object)} | {
            c: pd.Series(list(x), dtype="int64") for c, x in zip(["n", "total", "until"], held[1:])})

    def _keep(self, groups: pd.DataFrame) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if len(groups):
            self._groups.update(tuple(groups[c].tolist() for c in ["ref", "n", "total", "until"]))
            self._handle.registerTimer(int(groups["until"].min()))
        else:
            self._groups.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        groups = self._held()
        for batch in rows:
            new = batch.groupby("ref", sort=False).agg(
                n=("at", "size"), total=("net_amount", "sum"), until=("at", "max")).reset_index()
            new = new.astype({"n": "int64", "total": "int64", "until": "int64"})
            new["until"] += self._wait_ms
            groups = pd.concat([groups, new]).groupby("ref", sort=False).agg(
                n=("n", "sum"), total=("total", "sum"), until=("until", "max")).reset_index()
        self._keep(groups)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups = self._held()
        over = groups["until"] <= timerValues.getCurrentWatermarkInMs()
        self._keep(groups[~over])
        yield groups.loc[over, ["ref", "n", "total"]]

    def close(self) -> None:
        pass


def partial_groups(bank: DataFrame, wait_days: int, delay: str = "1 day") -> DataFrame:
    """(ref, n, total) of settlement groups, reported ``wait_days`` after their last row.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = bank.select(
        text.settlement_group_reference(F.col("utr_reference"), F.col("description")).alias("ref"),
        F.col("date").cast("timestamp").alias("ts"), "net_amount").filter("ref is not null").withColumns({
            "at": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("ref"), F.lit(BUCKETS))})
    return rows.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(
        PartialGroupState(wait_days * 86_400_000), "ref string, n long, total long", "append", "EventTime")


# --------------------------------------------------------------------- joins and matching

#: Most references of a micro-batch that are sent to all tasks.
BATCH_KEYS = 500_000


def match_stream_to_ledger(
    bank: DataFrame, ledger: DataFrame, matches_path: str, checkpoint: str, settings: Settings = Settings()
) -> StreamingQuery:
    """Settlements as they arrive against the ledger.

    Each micro-batch is matched against the orders that earlier batches left,
    and writes its matches into a folder of its own number: a repeated batch
    reads only the folders before it and replaces its own. Orders whose
    reference no settlement of the batch has cannot match; what is left without
    them is written, so the ledger is read once a batch and, while the batch's
    references are few, neither it nor the earlier matches are shuffled.
    """
    spark = ledger.sparkSession
    order_key = text.reference_key(F.col("customer_reference"))

    def write(batch: DataFrame, batch_id: int):
        earlier = [f"{matches_path}/batch_id={i}" for i in range(batch_id)]
        earlier = [p for p in earlier if path_exists(spark, p)]
        keys = batch.select(matchers.reference_key_of(batch).alias("_key")).filter("_key is not null").distinct()
        free = cut(ledger.join(broadcast_if_small(keys, BATCH_KEYS), order_key == F.col("_key"), "left_semi"), "batch-orders")
        if earlier:
            taken = spark.read.schema("settlement_id string, order_id string, rule_applied string").parquet(*earlier).select("order_id")
            taken = taken.join(broadcast_if_small(free.select("order_id"), BATCH_KEYS), "order_id", "left_semi")
            free = free.join(taken, "order_id", "left_anti")
        found = matchers.match_exact_then_tolerance(batch, free, settings)
        found.write.mode("overwrite").parquet(f"{matches_path}/batch_id={batch_id}")

    return run_batches(bank, write, checkpoint)


def bank_gateway_join(
    bank: DataFrame, gateway: DataFrame, days: int = 3, delay: str = "5 days", how: str = "inner"
) -> DataFrame:
    """Bank rows and payouts with one reference within ``days`` of each other, stream to stream."""
    b = bank.select(
        "settlement_id", F.col("utr_reference").alias("b_ref"), "net_amount", F.col("date").cast("timestamp").alias("b_ts")
    ).withWatermark("b_ts", delay)
    g = gateway.select(
        "payout_id", "order_id", F.col("utr_reference").alias("g_ref"), "net_payout",
        F.col("payout_date").cast("timestamp").alias("g_ts")).withWatermark("g_ts", delay)
    near = (
        (F.col("b_ref") == F.col("g_ref"))
        & (F.col("b_ts") >= F.col("g_ts") - F.expr(f"INTERVAL {days} DAYS"))
        & (F.col("b_ts") <= F.col("g_ts") + F.expr(f"INTERVAL {days} DAYS")))
    return b.join(g, near, how).select(
        "settlement_id", "payout_id", "order_id", "net_amount", "net_payout", "b_ts", "g_ts")
