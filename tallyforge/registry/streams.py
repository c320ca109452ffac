"""Registered queries: the streaming surface (R), run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.operators import matchers
from tallyforge.registry.core import Registry
from tallyforge.registry.oracle_ctes import GROUP_REF, with_ctes
from tallyforge.session import new_path
from tallyforge.sources import tables as t
from tallyforge.streaming import flows

CHUNK_DAYS, DELAY = 5, "6 days"


def _events(s, d) -> DataFrame:
    return t.table(s, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.floor(F.col("value") * 100 + F.lit(0.5)).cast("long").alias("cents"))


def _drops(s, d, late: bool = False) -> DataFrame:
    """Events as a stream of files in time order; ``late`` repeats every hundredth early event in the last ones."""
    path, e = new_path(s, "drops"), _events(s, d)
    bounds = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    day = F.floor((F.unix_seconds("ts") - F.lit(int(bounds.a.timestamp()))) / 86_400 / CHUNK_DAYS)
    chunks = int((bounds.b - bounds.a).days // CHUNK_DAYS) + 1
    for i in range(chunks):
        part = e.filter(day == i)
        if late and i == chunks - 1:
            part = part.unionByName(e.filter((day == 0) & (F.col("event_id") % 100 == 0)))
        part.write.mode("append").parquet(path)
    return flows.file_stream(s, path, e.schema, max_files=1)


E_SQL = "(SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"
CLOSED = "(SELECT max(ts) - INTERVAL 6 DAY FROM events)"


def _micros(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in cols})


def _bank_stream(s, d, max_files: int | None = None) -> DataFrame:
    """Bank rows as a drop folder. Its files are not in date order, so flows with a
    watermark take them in one trigger; others may take one file at a time."""
    path, b = new_path(s, "bank-drops"), t.bank(s, d)
    b.write.parquet(path)
    return flows.file_stream(s, path, b.schema, max_files=max_files)


def register(reg: Registry):
    reg.add("R1_R15_file_source_to_files", lambda s, d: flows.collect_stream(_drops(s, d), "copied").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("cents").alias("cents")), f"""
        SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM {E_SQL} GROUP BY 1""")

    def modes(s, d):
        out = None
        for mode in ("update", "complete"):
            rows = flows.collect_stream(flows.running_totals(_drops(s, d)), mode, mode)
            last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "cents"), "batch_id").alias("r")).select(
                "user_id", "r.n", "r.cents", F.lit(mode).alias("mode"))
            out = last if out is None else out.unionByName(last)
        return out

    reg.add("R4_R9_output_modes_and_running_state", modes, f"""
        SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, mode
        FROM {E_SQL}, (SELECT unnest(['update', 'complete']) AS mode) GROUP BY ALL""")
    hour = f"""SELECT epoch_us(w) AS "start", epoch_us(w) + {{width}} AS "end", event_type, count(*) AS n,
        CAST(sum(cents) AS BIGINT) AS cents FROM ({{rows}}) GROUP BY w, event_type
        HAVING w + to_microseconds({{width}}) <= {CLOSED}"""
    hourly = hour.format(width=3_600_000_000, rows=f"SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM {E_SQL}")
    reg.add("R5_watermark_drops_late_rows", lambda s, d: _micros(flows.collect_stream(
        flows.windowed_totals(_drops(s, d, late=True), DELAY, "1 hour"), "late"), "start", "end"), hourly)
    reg.add("R6_tumbling_window", lambda s, d: _micros(flows.collect_stream(
        flows.windowed_totals(_drops(s, d), DELAY, "1 hour"), "tumbling"), "start", "end"), hourly)
    reg.add("R7_sliding_window", lambda s, d: _micros(flows.collect_stream(
        flows.windowed_totals(_drops(s, d), DELAY, "6 hours", "2 hours"), "sliding"), "start", "end"), hour.format(
        width=21_600_000_000, rows=f"""SELECT *, time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS w
        FROM {E_SQL}, (SELECT unnest([0, 1, 2]) AS k)"""))
    reg.add("R8_session_window", lambda s, d: _micros(flows.collect_stream(
        flows.user_sessions(_drops(s, d), DELAY, "6 hours"), "sessions"), "start", "end"), f"""
        SELECT epoch_us(min(ts)) AS "start", epoch_us(max(ts)) + 21600000000 AS "end", user_id, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM (
                SELECT *, CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM (
                    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)))
        GROUP BY user_id, no HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}""")

    def deduplicated(s, d):
        path, e = new_path(s, "twice"), _events(s, d)
        e.unionByName(e.filter("event_id % 3 = 0")).write.parquet(path)
        return flows.collect_stream(
            flows.without_repeats(flows.file_stream(s, path, e.schema), "60 days"), "unique").groupBy("event_type").agg(
            F.count("*").alias("n"))

    reg.add("R10_deduplication", deduplicated, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")

    def partial(s, d):
        s.conf.set("spark.sql.streaming.stateStore.providerClass", flows.ROCKSDB)
        try:
            groups = flows.collect_stream(flows.partial_groups(_bank_stream(s, d), 30), "partial")
        finally:
            s.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return groups.filter("n >= 2").select("ref", "n", "total")

    reg.add("R11_partial_groups_with_state", partial, with_ctes(f"""
        SELECT ref, count(*) AS n, CAST(sum(net_amount) AS BIGINT) AS total FROM (
            SELECT *, {GROUP_REF} AS ref FROM bank) GROUP BY ref
        HAVING count(*) >= 2 AND max(date) + 30 <= (SELECT max(date) - 1 FROM bank)""", "bank"))

    def stream_static(s, d):
        out, check = new_path(s, "stream-matches"), new_path(s, "stream-checkpoint")
        flows.match_stream_to_ledger(_bank_stream(s, d, max_files=1), t.ledger(s, d), out, check)
        return s.read.parquet(out).select("settlement_id", "order_id", "rule_applied")

    reg.add("R12_R14_stream_static_match", stream_static, with_ctes(
        "SELECT settlement_id, order_id, rule_applied FROM found3", "found3"))

    def stream_stream(s, d):
        path, g = new_path(s, "gateway-drops"), t.gateway(s, d)
        g.write.parquet(path)
        joined = flows.bank_gateway_join(_bank_stream(s, d), flows.file_stream(s, path, g.schema))
        return flows.collect_stream(joined, "joined").select("settlement_id", "payout_id", "net_amount", "net_payout")

    reg.add("R13_stream_stream_join", stream_stream, with_ctes("""
        SELECT settlement_id, payout_id, net_amount, net_payout FROM bank b JOIN gateway g
        ON b.utr_reference = g.utr_reference AND abs(b.date - g.payout_date) <= 3""", "bank", "gateway"))

    def progressed(s, d):
        query = flows.run_to_files(_drops(s, d), new_path(s, "progress"), new_path(s, "progress-checkpoint"))
        rows = s.createDataFrame(flows.progress(query), "batch_id long, rows long")
        return rows.agg(F.sum("rows").alias("rows"), (F.max("batch_id") > 0).alias("several_batches"))

    reg.add("R16_checkpoint_and_progress", progressed, "SELECT count(*) AS rows, true AS several_batches FROM events")
