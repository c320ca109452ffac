"""Decisions on shortlisted pairs, and where each decision goes.

Answers of an external adjudicator enter as a table keyed by ``decision_key``;
nothing is called from inside a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyforge.functions import money, similarity, text
from tallyforge.settings import Settings

# Decision categories and the confidences given by rule.
DETERMINISTIC, LOCAL, NO_CAPACITY = (
    "DETERMINISTIC_FEES_MATCH", "LOCAL_FUZZY_SCORE_MATCH", "QUOTA_EXHAUSTED_REVIEW")
DETERMINISTIC_CONFIDENCE, NO_CAPACITY_CONFIDENCE = 0.98, 0.35
LOCAL_MINIMUM, LOCAL_LOW, LOCAL_HIGH = 0.50, 0.60, 0.85

DECISION = T.StructType([
    T.StructField("decision", T.StringType()),
    T.StructField("matched_order_id", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("rule_category", T.StringType()),
])


def candidate_rows(shortlisted: DataFrame, bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """Shortlist rows with the columns of both records, one flat row per pair."""
    s = bank.select(
        "settlement_id", "date", "amount", "net_amount", "fees_deducted", "tax_deducted", "utr_reference",
        "description")
    o = ledger.select("order_id", "expected_amount", "customer_reference")
    return (
        shortlisted.select(
            F.col("record_id").alias("settlement_id"), F.col("candidate_id").alias("order_id"),
            "similarity_score", "rank")
        .join(s, "settlement_id")
        .join(o, "order_id")
    )


def _clean(c: str) -> Column:
    return F.upper(money.strip(F.coalesce(F.col(c), F.lit(""))))


def reference_signal() -> Column:
    """Reference part of F10, over candidate rows."""
    utr, desc, order_id, ref = (
        _clean(c) for c in ("utr_reference", "description", "order_id", "customer_reference"))
    return (
        ((utr != "") & (order_id != "") & (utr == order_id))
        | ((utr != "") & (ref != "") & (utr == ref))
        | ((order_id != "") & desc.contains(order_id))
        | ((ref != "") & desc.contains(ref))
        | text.numbers_overlap(
            text.number_tokens(_clean("settlement_id"), utr), text.number_tokens(order_id, ref))
    )


def amount_signal(tolerance: int) -> Column:
    """Amount part of F10, over candidate rows."""
    gross, net, e = F.col("amount"), F.col("net_amount"), F.col("expected_amount")
    after_fee = money.one_step_net(e)
    return (
        (F.abs(gross - e) <= tolerance)
        | (F.abs(net - after_fee) <= tolerance)
        | (F.abs(gross - after_fee) <= tolerance)
    )


def precheck(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """per settlement the first candidate that passes both signals."""
    passed = rows.filter(reference_signal() & amount_signal(settings.amount_tolerance))
    return passed.groupBy("settlement_id").agg(
        F.min_by("order_id", "rank").alias("matched_order_id")
    ).select(
        "settlement_id", F.lit("match").alias("decision"), "matched_order_id",
        F.lit(DETERMINISTIC_CONFIDENCE).alias("confidence"),
        F.lit("Deterministic candidate match: reference and fee-adjusted amount agree").alias("reasoning"),
        F.lit(DETERMINISTIC).alias("rule_category"))


def local_score(rows: DataFrame) -> DataFrame:
    """the candidate with the most similar texts, first by rank on ties."""
    utr, desc, sid, ref, oid = (
        _clean(c) for c in ("utr_reference", "description", "settlement_id", "customer_reference", "order_id"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when((a != "") & (b != ""), similarity.sequence_ratio(a, b)).otherwise(0.0)

    scored = rows.withColumn("score", F.greatest(ratio(utr, ref), ratio(desc, ref), ratio(sid, oid)))
    best = scored.groupBy("settlement_id").agg(
        F.max(F.struct("score", (-F.col("rank")).alias("r"), "order_id")).alias("best")
    ).select("settlement_id", "best.score", F.col("best.order_id").alias("order_id"))
    good = F.col("score") >= LOCAL_MINIMUM
    percent = F.floor(F.col("score") * 100).cast("string")
    return best.select(
        "settlement_id",
        F.when(good, "match").otherwise("no_match").alias("decision"),
        F.when(good, F.col("order_id")).alias("matched_order_id"),
        F.when(good, F.bround(F.least(F.lit(LOCAL_HIGH), F.greatest(F.lit(LOCAL_LOW), F.col("score"))), 2))
        .otherwise(NO_CAPACITY_CONFIDENCE).alias("confidence"),
        F.when(good, F.concat(F.lit("Local scorer: reference similarity "), percent, F.lit("%")))
        .otherwise(F.concat(F.lit("Low reference similarity ("), percent, F.lit("%). Awaiting capacity.")))
        .alias("reasoning"),
        F.when(good, LOCAL).otherwise(NO_CAPACITY).alias("rule_category"),
    )


def decision_key(rows: DataFrame) -> DataFrame:
    """sha256 of 'settlement:sorted,order,ids' per settlement (top-k rows each)."""
    ids = F.array_join(F.sort_array(F.collect_list("order_id")), ",")
    return rows.groupBy("settlement_id").agg(
        F.sha2(F.concat(F.col("settlement_id"), F.lit(":"), ids), 256).alias("decision_key"))


def parse_decisions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decision_key, payload JSON) -> valid decisions and rejects."""
    parsed = raw.withColumn("d", F.from_json("payload", DECISION))
    valid = (
        F.col("d.decision").isin("match", "no_match")
        & F.col("d.confidence").between(0.0, 1.0)
        & F.col("d.reasoning").isNotNull()
        & F.col("d.rule_category").isNotNull()
    )
    ok = F.coalesce(valid, F.lit(False))
    return (
        parsed.filter(ok).select("decision_key", "d.*"),
        parsed.filter(~ok).select("decision_key", "payload"),
    )


def decide(
    rows: DataFrame,
    settings: Settings = Settings(),
    decisions: DataFrame | None = None,
    local_scorer: bool = True,
) -> DataFrame:
    """One decision per settlement with candidates: known answer, else F10, else F11."""
    cols = ["settlement_id", "decision", "matched_order_id", "confidence", "reasoning", "rule_category"]
    options = [precheck(rows, settings).withColumn("turn", F.lit(2))]
    if decisions is not None:
        known = decision_key(rows).join(decisions, "decision_key").select(*cols)
        options.append(known.withColumn("turn", F.lit(1)))
    if local_scorer:
        options.append(local_score(rows).withColumn("turn", F.lit(3)))
    all_options = options[0]
    for o in options[1:]:
        all_options = all_options.unionByName(o)
    first = all_options.groupBy("settlement_id").agg(F.min_by(F.struct(*cols[1:]), "turn").alias("d"))
    return first.select("settlement_id", "d.*")


def route(decisions: DataFrame, free: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """free settlements -> outcome in auto_matched, needs_review, pending_verification, exception.

    ``free`` holds settlement_id and date. An order goes to the first
    settlement that is matched to it; the later ones become exceptions.
    """
    d = free.select("settlement_id", "date").join(decisions, "settlement_id", "left")
    is_match = F.coalesce(
        (F.col("decision") == "match") & F.col("matched_order_id").isNotNull(), F.lit(False))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    auto = is_match & (conf >= settings.auto_match_confidence)
    winners = (
        d.filter(auto)
        .groupBy("matched_order_id")
        .agg(F.min(F.struct("date", "settlement_id")).alias("w"))
        .select(F.col("w.settlement_id").alias("settlement_id"), F.lit(True).alias("won"))
    )
    review = is_match & ~auto & (conf >= settings.needs_review_confidence)
    outcome = (
        F.when(auto & F.col("won"), "auto_matched")
        .when(auto, "exception")
        .when(review, "needs_review")
        .when(F.col("rule_category") == NO_CAPACITY, "pending_verification")
        .otherwise("exception")
    )
    rule = F.when(F.col("outcome") == "auto_matched", F.concat(F.lit("ADJUDICATED_"), "rule_category")).when(
        F.col("outcome") == "needs_review", F.concat(F.lit("NEEDS_HUMAN_REVIEW_"), "rule_category"))
    return (
        d.join(winners, "settlement_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("rule_applied", rule)
        .drop("won")
    )


def top_per_settlement(rows: DataFrame) -> DataFrame:
    """W2 at k = 1: the best candidate row of each settlement."""
    w = Window.partitionBy("settlement_id").orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
