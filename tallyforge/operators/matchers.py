"""M1-M8: the matching phases, each a function of the free settlements and orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge import settings as fixed
from tallyforge.functions import money, text
from tallyforge.operators import assignment
from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut
from tallyforge.settings import Settings


# --------------------------------------------------------------------- one order per reference

@dataclass(frozen=True)
class ReferenceRule:
    """A phase that pairs rows of one reference key: M2, M3/M4 or M8."""

    phase: int
    accept: Column  # over the columns of both sides
    label: Column
    arms: Sequence[tuple[Column, Column]]
    width: int
    days: int | None


def _near(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def exact_rule(settings: Settings) -> ReferenceRule:
    """M2."""
    tol, net, e = settings.strict_tolerance, F.col("net_amount"), F.col("expected_amount")
    return ReferenceRule(
        2, _near(net, e, tol) & _within_days(settings), F.lit(fixed.RULE_EXACT), [(net, e)], tol,
        settings.date_tolerance_days,
    )


def tolerance_rule(settings: Settings) -> ReferenceRule:
    """M3 and, where no fee explains the amount, M4."""
    tol, net, e, fees = (
        settings.strict_tolerance, F.col("net_amount"), F.col("expected_amount"), F.col("fees_deducted"),
    )
    fee = _near(net, F.col("net_two_step"), tol) | ((fees > 0) & _near(net, e - fees, tol))
    return ReferenceRule(
        3,
        (fee | _near(net, e, tol)) & _within_days(settings),
        F.when(fee, fixed.RULE_FEE).otherwise(fixed.RULE_ROUNDING),
        [(net, F.col("net_two_step")), (net, e), (net + fees, e)],
        tol,
        settings.date_tolerance_days,
    )


def lag_rule(settings: Settings) -> ReferenceRule:
    """M8. No date test, and the tolerance is not capped."""
    tol, net, e = settings.amount_tolerance, F.col("net_amount"), F.col("expected_amount")
    return ReferenceRule(
        8, _near(net, e, tol) | _near(net, F.col("net_one_step"), tol), F.lit(fixed.RULE_LAG),
        [(net, e), (net, F.col("net_one_step"))], tol, None,
    )


def _within_days(settings: Settings) -> Column:
    return F.abs(F.datediff("date", "expected_settlement_date")) <= settings.date_tolerance_days


def _settlement_side(bank: DataFrame, key: Column) -> DataFrame:
    return bank.select(
        key.alias("key"), "date", "net_amount", "fees_deducted",
        F.struct("date", "settlement_id").alias("s_pos"),
    ).filter("key is not null")


def _order_side(ledger: DataFrame) -> DataFrame:
    e = F.col("expected_amount")
    return ledger.select(
        text.reference_key(F.col("customer_reference")).alias("key"),
        "expected_settlement_date", "expected_amount",
        F.struct("ingest_seq", "order_id").alias("o_pos"),
    ).filter("key is not null").withColumns(
        {"net_two_step": money.two_step_net(e), "net_one_step": money.one_step_net(e)}
    )


def match_by_reference(
    bank: DataFrame,
    ledger: DataFrame,
    rules: Sequence[ReferenceRule],
    key: Column,
    settings: Settings = Settings(),
) -> DataFrame:
    """Run ``rules`` one after the other over rows that share a reference key.

    Edges never leave a key, so all rules of a small key are folded together
    in one pass after one shuffle; only keys above the pair limit go through
    the round-based form, which never lists their pairs.
    """
    s, o = _settlement_side(bank, key), _order_side(ledger)
    hot = cut(assignment.hot_keys(s, o, settings), "hot-keys")
    has_hot = not hot.isEmpty()
    cold_s, cold_o = (s, o) if not has_hot else (
        s.join(hot, "key", "left_anti"), o.join(hot, "key", "left_anti"))
    pair = cold_s.join(cold_o, "key")
    chosen = F.filter(
        F.array(*[
            F.when(r.accept, F.struct(F.lit(r.phase).alias("phase"), r.label.alias("label"))) for r in rules
        ]),
        lambda x: x.isNotNull(),
    )
    edges = pair.select("key", "s_pos", "o_pos", F.inline(chosen)).select(
        "key", "phase", "s_pos", "o_pos", "label")
    found = assignment.fold_by_key(edges)
    if has_hot:
        found = found.unionByName(
            _match_hot(s.join(hot, "key", "left_semi"), o.join(hot, "key", "left_semi"), rules, settings))
    return found.select(
        F.col("s_pos.settlement_id").alias("settlement_id"),
        F.col("o_pos.order_id").alias("order_id"),
        F.col("label").alias("rule_applied"),
    )


def _match_hot(s: DataFrame, o: DataFrame, rules: Sequence[ReferenceRule], settings: Settings) -> DataFrame:
    s_cols = ["key", "date", "net_amount", "fees_deducted"]
    o_cols = ["key", "expected_settlement_date", "expected_amount", "net_two_step", "net_one_step"]
    s = cut(s.withColumn("a", F.sha2(F.to_json(F.struct(*s_cols)), 256)), "hot-s")
    o = cut(o.withColumn("b", F.sha2(F.to_json(F.struct(*o_cols)), 256)), "hot-o")
    found = None
    for rule in rules:
        s_free, o_free = s, o
        if found is not None:
            s_free = s.join(found.select("s_pos"), "s_pos", "left_anti")
            o_free = o.join(found.select("o_pos"), "o_pos", "left_anti")
        edges = assignment.near_classes(
            s_free.select("a", *s_cols).distinct(), o_free.select("b", *o_cols).distinct(), ["key"],
            rule.arms, rule.width, rule.accept,
            (_day("date"), _day("expected_settlement_date"), rule.days) if rule.days is not None else None,
        )
        pairs = assignment.assign_in_rounds(
            s_free.select("a", "s_pos"), o_free.select("b", "o_pos"), cut(edges, "hot-edges"), settings)
        labelled = (
            pairs.join(s.drop("key", "a"), "s_pos").join(o.drop("key", "b"), "o_pos")
            .select("s_pos", "o_pos", rule.label.alias("label"))
        )
        labelled = cut(labelled, "hot-matches")
        found = labelled if found is None else found.unionByName(labelled)
    return found


def reference_key_of(bank: DataFrame) -> Column:
    """Key of M2-M4: the reference, else the REF word of the description."""
    return text.settlement_key(bank["utr_reference"], bank["description"])


def match_exact(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return match_by_reference(bank, ledger, [exact_rule(settings)], reference_key_of(bank), settings)


def match_tolerance(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return match_by_reference(bank, ledger, [tolerance_rule(settings)], reference_key_of(bank), settings)


def match_exact_then_tolerance(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    rules = [exact_rule(settings), tolerance_rule(settings)]
    return match_by_reference(bank, ledger, rules, reference_key_of(bank), settings)


def match_timing_lag(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    key = text.reference_key(bank["utr_reference"])
    return match_by_reference(bank, ledger, [lag_rule(settings)], key, settings)


# --------------------------------------------------------------------- groups against one order

def partial_groups(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """M5/M6 decided per reference: one row per group of two or more settlements."""
    tol, e = settings.strict_tolerance, F.col("expected_amount")
    orders = ledger.select(
        F.coalesce(
            text.group_reference(F.col("customer_reference")), text.group_reference(F.col("order_id"))).alias("ref"),
        F.struct("ingest_seq", "order_id", "expected_amount").alias("order"))
    groups = (
        bank.select(
            text.settlement_group_reference(F.col("utr_reference"), F.col("description")).alias("ref"),
            "net_amount",
        )
        .filter("ref is not null")
        .groupBy("ref")
        .agg(F.count("*").alias("n"), F.sum("net_amount").alias("total"))
        .filter("n >= 2")
    )
    fee_net = money.two_step_net(e)
    # Few references have a group, so the orders of the others are not put in order.
    last = groups.join(orders, "ref").groupBy("ref", "n", "total").agg(F.max("order").alias("last"))
    return (
        last.select("ref", "n", "total", "last.order_id", "last.expected_amount")
        .withColumn("fee_net", fee_net)
        .withColumn(
            "rule_applied",
            F.when(
                _near(F.col("total"), e, tol) | _near(F.col("total"), F.col("fee_net"), tol),
                fixed.RULE_PARTIAL,
            ).when(F.col("total") > 0, fixed.RULE_SHORTFALL),
        )
        .filter("rule_applied is not null")
        .withColumn("variance_paise", F.col("fee_net") - F.col("total"))
    )


def match_partial(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """M5 and M6: every settlement of an accepted group goes to the group's order."""
    groups = partial_groups(bank, ledger, settings).select("ref", "order_id", "rule_applied")
    return (
        bank.select(
            "settlement_id",
            text.settlement_group_reference(F.col("utr_reference"), F.col("description")).alias("ref"),
        )
        .join(groups, "ref")
        .select("settlement_id", "order_id", "rule_applied")
    )


def match_split(bank: DataFrame, ledger: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """M7: the payer's first fitting settlement takes all of the customer's free orders."""
    tol = settings.strict_tolerance
    orders = ledger.select(
        text.reference_key(F.col("customer_name")).alias("payer"), "order_id", "expected_amount"
    ).filter("payer is not null")
    totals = (
        orders.groupBy("payer")
        .agg(F.count("*").alias("n"), F.sum("expected_amount").alias("gross"))
        .filter("n >= 2")
    )
    winners = (
        bank.select(
            text.reference_key(F.col("payer_account")).alias("payer"), "date", "settlement_id", "net_amount")
        .join(totals, "payer")
        .filter(
            _near(F.col("net_amount"), F.col("gross"), tol)
            | _near(F.col("net_amount"), money.two_step_net(F.col("gross")), tol)
        )
        .groupBy("payer")
        .agg(F.min(F.struct("date", "settlement_id")).alias("first"))
        .select("payer", "first.settlement_id")
    )
    return orders.join(winners, "payer").select(
        "settlement_id", "order_id", F.lit(fixed.RULE_SPLIT).alias("rule_applied"))


# --------------------------------------------------------------------- three-way triangulation

def _id_lengths(df: DataFrame, column: str) -> list[int]:
    """Distinct id lengths: as many values as an id has characters, whatever the table size."""
    rows = df.select(F.length(column).alias("n")).filter("n > 0").distinct().collect()
    return sorted(r.n for r in rows)


def triangulation_links(bank: DataFrame, gateway: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seven ways a bank row can name a payout, as equal tokens on both sides.

    The OR of the conditions would be a nested loop; as tokens it is one
    equi-join. "Description contains an id" becomes a join on the description's
    substrings of the lengths that ids have, so ids are matched literally.
    """
    utr, sid, desc = F.col("utr_reference"), F.col("settlement_id"), F.col("description")

    def token(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(kind), value))

    def tokens(*parts: Column) -> Column:
        return F.array_distinct(F.filter(F.concat(*parts), lambda t: t.isNotNull()))

    in_text = F.concat(
        F.transform(
            F.coalesce(text.substrings_of(desc, _id_lengths(gateway, "order_id")), F.array().cast("array<string>")),
            lambda w: token("O:", w)),
        F.transform(
            F.coalesce(text.substrings_of(desc, _id_lengths(gateway, "payout_id")), F.array().cast("array<string>")),
            lambda w: token("P:", w)),
    )
    named = F.array(
        token("U:", utr), token("I:", sid), token("I:", utr),
        token("I:", F.replace(sid, F.lit("STL"), F.lit("PAY"))),
        token("I:", F.replace(sid, F.lit("STL"), F.lit("PAYOUT"))),
    )
    s = bank.select(
        "settlement_id", "date", "net_amount", F.explode(tokens(named, in_text)).alias("token"))
    g = gateway.select(
        "payout_id", "order_id", "net_payout",
        F.explode(
            tokens(F.array(
                token("U:", utr), token("I:", F.col("payout_id")),
                token("O:", F.nullif(F.col("order_id"), F.lit(""))),
                token("P:", F.nullif(F.col("payout_id"), F.lit(""))),
            ))
        ).alias("token"),
    )
    return s, g


def match_triangulation(
    bank: DataFrame, gateway: DataFrame, ledger: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """M1. Edges cross reference keys, so this is always assigned in rounds."""
    tol, e, net = settings.strict_tolerance, F.col("expected_amount"), F.col("net_amount")
    s, g = triangulation_links(bank, gateway)
    g = g.join(ledger.select("order_id", "expected_amount", "ingest_seq"), "order_id")
    # Tokens the other side does not have cannot join; without them rows that
    # differ only in such tokens fall into one class.
    s = s.join(g.select("token").distinct(), "token", "left_semi")
    s = cut(s, "bank-tokens")
    g = cut(g.join(s.select("token").distinct(), "token", "left_semi"), "payout-tokens")

    s_members = s.groupBy("settlement_id", "date", "net_amount").agg(
        F.sha2(F.to_json(F.struct("net_amount", F.sort_array(F.collect_set("token")))), 256).alias("a"))
    o_members = g.groupBy("order_id", "ingest_seq", "expected_amount").agg(
        F.sha2(
            F.to_json(
                F.struct("expected_amount", F.sort_array(F.collect_set(F.struct("token", "net_payout"))))
            ), 256,
        ).alias("b"))
    s_members, o_members = cut(s_members, "bank-classes"), cut(o_members, "order-classes")
    s_rows = s.join(s_members.select("settlement_id", "a"), "settlement_id").select(
        "a", "token", "net_amount").distinct()
    o_rows = g.join(o_members.select("order_id", "b"), "order_id").select(
        "b", "token", "net_payout", "expected_amount").distinct()
    nets = [F.col("net_payout"), money.two_step_net(e), e - money.mdr_fee(e), e]
    accept = _near(net, nets[0], tol)
    for x in nets[1:]:
        accept = accept | _near(net, x, tol)
    edges = assignment.near_classes(s_rows, o_rows, ["token"], [(net, x) for x in nets], tol, accept)
    pairs = assignment.assign_in_rounds(
        s_members.select("a", F.struct("date", "settlement_id").alias("s_pos")),
        o_members.select("b", F.struct("ingest_seq", "order_id").alias("o_pos")),
        cut(edges, "triangulation-edges"),
        settings,
    )
    found = pairs.select(
        F.col("s_pos.settlement_id").alias("settlement_id"), F.col("o_pos.order_id").alias("order_id"))
    # The payout that a pair went through: the first by id that fits.
    through = (
        found.join(s.select("settlement_id", "token", "net_amount"), "settlement_id")
        .join(g, ["order_id", "token"])
        .filter(accept)
        .groupBy("settlement_id", "order_id")
        .agg(F.min("payout_id").alias("payout_id"))
    )
    return through.withColumn("rule_applied", F.lit(fixed.RULE_GATEWAY))


# --------------------------------------------------------------------- what is left

def unmatched(records: DataFrame, matches: DataFrame, id_column: str) -> DataFrame:
    """J1."""
    return records.join(matches.select(id_column), id_column, "left_anti")


def settled_references(bank: DataFrame, matches: DataFrame) -> DataFrame:
    """References of settled bank rows, as they are written."""
    return (
        bank.filter("utr_reference is not null and utr_reference <> ''")
        .join(matches.select("settlement_id"), "settlement_id", "left_semi")
        .select("utr_reference")
        .distinct()
    )


def visiting_order(bank: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The settlements' order inside a reference key; never one order over the whole table."""
    keyed = bank.withColumn("key", reference_key_of(bank)).filter("key is not null")
    return with_rank(keyed, ["key"], ["date", "settlement_id"], "visit", settings)
