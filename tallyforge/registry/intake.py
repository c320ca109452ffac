"""Registered queries: ingestion, stored tables and normalisers (S, N, U1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.functions import money, text
from tallyforge.plans import analytics, views
from tallyforge.registry.core import Registry
from tallyforge.registry.oracle_ctes import inr_text, mdr, one_step, two_step, with_ctes
from tallyforge.session import new_path
from tallyforge.sources import ingest, store, tables as t


def _k() -> Column:
    return F.col("ingest_seq")


def _styled_amount(c: Column, k: Column) -> Column:
    plain = money.inr_text(c)
    return (
        F.when(k % 4 == 0, F.concat(F.lit("Rs. "), plain)).when(k % 4 == 1, plain)
        .when(k % 4 == 2, F.concat(F.lit("₹"), F.format_number((c.cast("decimal(20,0)") / 100).cast("decimal(20,2)"), 2)))
        .otherwise(F.concat(F.lit("INR "), plain)))


def _styled_date(c: Column, k: Column) -> Column:
    return (
        F.when(k % 4 == 0, F.date_format(c, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(c, "d/M/yyyy"))
        .when(k % 4 == 2, F.date_format(c, "dd-MM-yyyy")).otherwise(F.date_format(c, "yyyy/M/d")))


def _dirty(df: DataFrame, date: str, amount: str, marker: str) -> DataFrame:
    """Text rows with unreadable dates and amounts, exact repeats and reused ids."""
    k = F.col("ingest_seq")
    cols = [c for c in df.columns if c != "ingest_seq"]
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    longs = [f.name for f in df.schema if f.dataType.typeName() == "long" and f.name != "ingest_seq"]
    shown = {c: F.col(c) for c in cols}
    for c in dates:
        shown[c] = _styled_date(F.col(c), k)
    for c in longs:
        shown[c] = _styled_amount(F.col(c), k)
    shown[date] = F.when(k % 97 == 0, "2026-99-99").otherwise(shown[date])
    shown[amount] = F.when(k % 89 == 0, "bad amount").otherwise(shown[amount])
    row = F.struct(*[shown[c].alias(c) for c in cols])
    reused = F.struct(*[(F.lit("reused") if c == marker else shown[c]).alias(c) for c in cols])
    copies = (
        F.when(k % 50 == 0, F.array(row, row)).when(k % 60 == 1, F.array(row, reused)).otherwise(F.array(row)))
    return df.select(F.inline(copies))


def _through_csv(spark, df: DataFrame) -> DataFrame:
    path = new_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return ingest.read_csv(spark, path)


def _bank_raw(s, d):
    return _through_csv(s, _dirty(t.bank(s, d), "date", "net_amount", "description"))


def _ledger_raw(s, d):
    return _through_csv(s, _dirty(t.ledger(s, d), "invoice_date", "expected_amount", "status"))


_STATS = """
    SELECT total, valid, total - valid - duplicates AS invalid, duplicates FROM (
        SELECT CAST(sum(1 + CASE WHEN ingest_seq % 50 = 0 OR ingest_seq % 60 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS total,
               CAST(sum(CASE WHEN ingest_seq % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates,
               CAST(sum(CASE WHEN ingest_seq % 97 <> 0 AND ingest_seq % 89 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid
        FROM {})"""
_GOOD = "ingest_seq % 97 <> 0 AND ingest_seq % 89 <> 0"


def _gateway_raw(s, d):
    g, k = t.gateway(s, d), F.col("ingest_seq")
    cols = [c for c in g.columns if c != "ingest_seq"]
    shown = {c: F.col(c) for c in cols}
    shown["payout_date"] = _styled_date(F.col("payout_date"), k)
    for c in ("gross_amount", "gateway_fee", "gateway_tax", "net_payout"):
        shown[c] = _styled_amount(F.col(c), k)
    shown["gateway_tax"] = F.when(k % 13 == 0, "").otherwise(shown["gateway_tax"])
    first = F.struct(*[shown[c].alias(c) for c in cols])
    again = F.struct(*[(F.lit("REFUNDED") if c == "status" else shown[c]).alias(c) for c in cols])
    return _through_csv(s, g.select(F.inline(
        F.when(k % 3 == 0, F.array(first, again)).otherwise(F.array(first)))))


def _truth_rows(s, d):
    path = new_path(s, "truth")
    g = t.ground_truth(s, d)
    k = F.substring("order_id", 4, 9).cast("long")
    row = lambda flag: F.struct("settlement_id", "order_id", flag.cast("string").alias("is_true_match"))
    g.select(F.inline(
        F.when(k % 10 == 0, F.array(row(~F.col("is_true_match")), row(F.col("is_true_match"))))
        .otherwise(F.array(row(F.col("is_true_match")))))).write.option("header", True).csv(path)
    return ingest.read_ground_truth(s, path)


def register(reg: Registry):
    reg.add("S1_bank_ingest_stats", lambda s, d: ingest.ingest(_bank_raw(s, d), ingest.BANK).stats,
            with_ctes(_STATS.format("bank"), "bank"))
    reg.add(
        "S1_bank_ingest_rows",
        lambda s, d: ingest.ingest(_bank_raw(s, d), ingest.BANK).rows.drop("ingest_seq"),
        with_ctes(f"""SELECT settlement_id, CAST(date AS VARCHAR) AS date, amount, utr_reference, payer_account,
            fees_deducted, tax_deducted, net_amount, description, currency FROM bank WHERE {_GOOD}""", "bank"))
    reg.add("S2_ledger_ingest_stats", lambda s, d: ingest.ingest(_ledger_raw(s, d), ingest.LEDGER).stats,
            with_ctes(_STATS.format("ledger"), "ledger"))
    reg.add(
        "S2_ledger_ingest_rows",
        lambda s, d: ingest.ingest(_ledger_raw(s, d), ingest.LEDGER).rows.drop("ingest_seq"),
        with_ctes(f"""SELECT order_id, CAST(invoice_date AS VARCHAR) AS invoice_date, expected_amount, customer_name,
            customer_reference, CAST(expected_settlement_date AS VARCHAR) AS expected_settlement_date, tax_amount,
            currency, status FROM ledger WHERE {_GOOD}""", "ledger"))
    reg.add(
        "S3_gateway_ingest",
        lambda s, d: ingest.ingest_gateway(_gateway_raw(s, d)).rows.drop("ingest_seq"),
        with_ctes("""SELECT payout_id, CAST(payout_date AS VARCHAR) AS payout_date, order_id, utr_reference,
            gross_amount, gateway_fee, gateway_tax, net_payout,
            CASE WHEN ingest_seq % 3 = 0 THEN 'REFUNDED' ELSE status END AS status
            FROM gateway WHERE ingest_seq % 13 <> 0""", "gateway"))
    reg.add(
        "S4_ground_truth_scan",
        lambda s, d: ingest.last_flags(_truth_rows(s, d)),
        with_ctes("SELECT settlement_id, order_id, is_true_match FROM truth", "truth"))
    reg.add(
        "S5_validation_report",
        lambda s, d: ingest.validation_report(_bank_raw(s, d), ingest.BANK).groupBy("record_id").agg(
            F.count("*").alias("n"), F.max(F.substring_index("message", "): ", -1)).alias("message")),
        with_ctes("""SELECT settlement_id AS record_id,
            CASE WHEN ingest_seq % 50 = 0 OR ingest_seq % 60 = 1 THEN 2 ELSE 1 END AS n,
            concat_ws('; ', CASE WHEN ingest_seq % 97 = 0 THEN
                'date: Value error, Invalid date format: 2026-99-99' END,
                CASE WHEN ingest_seq % 89 = 0 THEN
                'net_amount: Value error, Invalid amount format: bad amount' END) AS message
            FROM bank WHERE ingest_seq % 97 = 0 OR ingest_seq % 89 = 0""", "bank"))

    def upserted(s, d):
        old = t.bank(s, d)
        new = old.filter("ingest_seq % 3 = 0").withColumn("net_amount", F.col("net_amount") + 1).unionByName(
            old.filter("ingest_seq % 7 = 0").withColumn("settlement_id", F.concat(F.lit("NEW"), "settlement_id")))
        return ingest.upsert(old, new, "settlement_id").select("settlement_id", "date", "net_amount")

    reg.add("S6_upsert_by_key", upserted, with_ctes("""
        SELECT settlement_id, CAST(date AS VARCHAR) AS date,
               net_amount + CASE WHEN ingest_seq % 3 = 0 THEN 1 ELSE 0 END AS net_amount FROM bank
        UNION ALL SELECT 'NEW' || settlement_id, CAST(date AS VARCHAR), net_amount FROM bank
        WHERE ingest_seq % 7 = 0""", "bank"))

    when = dt.datetime(2026, 7, 31, 12, 0)

    def audit(s, d):
        st = store.Store(s, new_path(s, "store"))
        m = views.matches(s, d)
        st.append_audit(m, "b1", when, json_lines=True)
        st.append_audit(m.filter("phase > 4"), "b2", when)
        json = s.read.json(st._path("audit_log_json")).groupBy("rule_applied").agg(F.count("*").alias("n_json"))
        rows = st.read("audit_log").groupBy("rule_applied").agg(F.count("*").alias("n_table"))
        return rows.join(json, "rule_applied")

    reg.add("S7_audit_append", audit, with_ctes("""
        SELECT rule_applied, count(*) AS n_json, count(*) * CASE WHEN phase > 4 THEN 2 ELSE 1 END AS n_table
        FROM matches GROUP BY rule_applied, phase""", "matches"))

    def replaced(s, d):
        st = store.Store(s, new_path(s, "store"))
        x = views.exceptions(s, d)
        st.replace_batch("exceptions", x, "b1")
        st.replace_batch("exceptions", x, "b2")
        st.replace_batch("exceptions", x.filter("priority = 'HIGH'"), "b1")
        return st.read("exceptions").groupBy("batch_id", "category").agg(F.count("*").alias("n"))

    reg.add("S8_replace_per_batch", replaced, with_ctes("""
        SELECT 'b1' AS batch_id, category, count(*) AS n FROM exceptions WHERE priority = 'HIGH' GROUP BY 2
        UNION ALL SELECT 'b2', category, count(*) FROM exceptions GROUP BY 2""", "exceptions"))

    def batches(s, d):
        o = t.table(s, d, "orders").select(
            F.concat(F.lit("batch_"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"), "o_orderkey")
        name = F.when(F.col("o_orderkey") % 2 == 0, "bank_settlements.csv").otherwise("internal_ledger.csv")
        return store.latest_complete_batch(
            o.select("batch_id", name.alias("file_name")).distinct(),
            ["bank_settlements.csv", "internal_ledger.csv"])

    reg.add("S9_latest_complete_batch", batches, """
        SELECT max(batch_id) AS batch_id FROM (
            SELECT 'batch_' || strftime(o_orderdate, '%Y%m') AS batch_id FROM orders GROUP BY 1
            HAVING count(DISTINCT o_orderkey % 2) = 2)""")

    def manifest(s, d):
        o = t.table(s, d, "orders")
        return o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("id")).agg(
            F.max("o_orderdate").alias("saved_at"), F.count("*").alias("total_records"))

    reg.add("S10_W7_snapshot_retention", lambda s, d: store.kept_snapshots(manifest(s, d)).select(
        "id", F.to_date("saved_at").alias("saved_at"), "total_records"), """
        SELECT id, CAST(CAST(saved_at AS DATE) AS VARCHAR) AS saved_at, total_records FROM (
            SELECT strftime(o_orderdate, '%Y%m') AS id, max(o_orderdate) AS saved_at, count(*) AS total_records
            FROM orders GROUP BY 1) ORDER BY saved_at DESC, id DESC LIMIT 10""")

    def snapshot(s, d):
        st = store.Store(s, new_path(s, "store"))
        for i, phase in enumerate((2, 3, 5)):
            st.save_snapshot(f"s{i}", f"phase {phase}", when + dt.timedelta(hours=i), {
                "audit_log": views.matches(s, d).filter(F.col("phase") <= phase),
                "exceptions": views.exceptions(s, d)})
        st.delete_snapshot("s2")
        back = st.restore_snapshot()
        shape = views.exceptions(s, d).withColumn("note", F.lit(None).cast("string")).drop("is_exception")
        restored = store.restore_into(shape, back["exceptions"])
        return back["audit_log"].groupBy("rule_applied").agg(F.count("*").alias("n")).unionByName(
            restored.groupBy(F.col("category").alias("rule_applied")).agg(F.count("*").alias("n")))

    reg.add("S11_S12_snapshot_restore_and_delete", snapshot, with_ctes("""
        SELECT rule_applied, count(*) AS n FROM matches WHERE phase <= 3 GROUP BY 1
        UNION ALL SELECT category, count(*) FROM exceptions GROUP BY 1""", "matches", "exceptions"))

    def exported(s, d):
        items = analytics.tax_line_items(views.matches(s, d), t.bank(s, d), t.ledger(s, d), limit=None)
        path = new_path(s, "gst")
        store.gst_export(items).write.option("header", True).csv(path)
        back = s.read.option("header", True).csv(path)
        return back.groupBy("Audit Status").agg(
            F.count("*").alias("n"),
            F.sum(F.rint(F.col("GST Amount INR").cast("double") * 100).cast("long")).alias("gst"),
            F.sum(F.rint(F.col("Net Credit INR").cast("double") * 100).cast("long")).alias("net")
        ).withColumnRenamed("Audit Status", "audit_status")

    reg.add("S13_gst_export", exported, with_ctes("""
        SELECT 'CLEAN_TAX_VERIFIED' AS audit_status, count(*) AS n,
               CAST(sum(CAST(round_even(amount * CAST(18.0 AS DOUBLE) / 100, 0) AS BIGINT)) AS BIGINT) AS gst,
               CAST(sum(net_amount) AS BIGINT) AS net FROM audited""", "audited"))

    def comments(s, d):
        e = t.table(s, d, "events").select(
            F.concat(F.lit("STL"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("record_id"),
            F.concat(F.lit("analyst "), "event_type").alias("analyst_name"),
            F.col("props").alias("comment_text"), F.col("ts").alias("timestamp"))
        st = store.Store(s, new_path(s, "store"))
        st.append_comments(e)
        return st.comments("STL000000007").select(
            "analyst_name", "comment_text", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))

    reg.add("S14_comments_newest_first", comments, """
        SELECT 'analyst ' || event_type AS analyst_name, props AS comment_text, epoch_us(ts) AS at
        FROM events WHERE user_id = 7""")

    def rematch(s, d):
        x, l = views.exceptions(s, d), t.ledger(s, d)
        overrides = x.filter("category = 'ORPHAN_BANK_SETTLEMENT'").select(
            F.col("record_id").alias("settlement_id"),
            F.concat(F.lit("ORD"), F.substring("record_id", 4, 9)).alias("order_id"),
            F.lit("Analyst").alias("analyst_name"), F.lit(when).alias("timestamp"))
        m, left, fb = store.apply_rematches(views.matches(s, d), x, overrides)
        return (
            m.groupBy(F.col("rule_applied").alias("what")).agg(F.count("*").alias("n"))
            .unionByName(left.groupBy(F.col("category").alias("what")).agg(F.count("*").alias("n")))
            .unionByName(fb.groupBy(F.col("feedback").alias("what")).agg(F.count("*").alias("n"))))

    reg.add("S15_manual_rematch", rematch, with_ctes("""
        SELECT rule_applied AS what, count(*) AS n FROM matches GROUP BY 1
        UNION ALL SELECT category, count(*) FROM exceptions WHERE category <> 'ORPHAN_BANK_SETTLEMENT' GROUP BY 1
        UNION ALL SELECT unnest(['MANUAL_HUMAN_REMATCH_OVERRIDE', 'MANUAL_REMATCH_APPROVED']), n FROM (
            SELECT count(*) AS n FROM exceptions WHERE category = 'ORPHAN_BANK_SETTLEMENT')""",
        "matches", "exceptions"))
    reg.add(
        "S17_journal_lines",
        lambda s, d: store.journal_lines(views.matches(s, d), t.bank(s, d)).groupBy("account", "side").agg(
            F.count("*").alias("n"), F.sum("amount_paise").alias("total")),
        with_ctes(f"""
            SELECT account, side, count(*) AS n, CAST(sum(p) AS BIGINT) AS total FROM (
                SELECT unnest(['Bank Nodal Account', 'Payment Gateway Fee Account', 'Customer Order Receivable']) AS account,
                       unnest(['DEBIT', 'DEBIT', 'CREDIT']) AS side,
                       unnest([{one_step('amount')}, amount - {one_step('amount')}, amount]) AS p
                FROM bank WHERE settlement_id IN (SELECT settlement_id FROM matches)) GROUP BY ALL""",
            "bank", "matches"))

    # Normalisers, over every order or bank row.
    reg.add(
        "N1_amount_to_paise",
        lambda s, d: t.ledger(s, d).select(
            "order_id",
            money.amount_to_paise(
                F.when(_k() % 9 == 0, "invalid_amount").when(_k() % 9 == 1, "")
                .when(_k() % 9 == 2, F.col("expected_amount").cast("string"))
                .when(_k() % 9 == 3, (F.col("expected_amount") % 1000).cast("string"))
                .otherwise(_styled_amount(F.col("expected_amount"), _k()))).alias("paise")),
        with_ctes("""SELECT order_id, CASE WHEN ingest_seq % 9 IN (0, 1) THEN NULL
            WHEN ingest_seq % 9 = 3 THEN (expected_amount % 1000) * 100 ELSE expected_amount END AS paise
            FROM ledger""", "ledger"))
    reg.add(
        "N2_date_parse",
        lambda s, d: t.ledger(s, d).select(
            "order_id", money.parse_date(
                F.when(_k() % 9 == 0, "2026-99-99").when(_k() % 9 == 1, " ").otherwise(
                    F.concat(F.lit(" "), _styled_date(F.col("invoice_date"), _k())))).alias("day")),
        with_ctes("""SELECT order_id, CASE WHEN ingest_seq % 9 > 1 THEN CAST(invoice_date AS VARCHAR) END AS day
            FROM ledger""", "ledger"))
    reg.add(
        "N3_blank_reference_to_null",
        lambda s, d: t.bank(s, d).select("settlement_id", money.blank_to_null(
            F.when(_k() % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "utr_reference"))).alias("ref")),
        with_ctes("""SELECT settlement_id, CASE WHEN ingest_seq % 2 <> 0 THEN utr_reference END AS ref FROM bank""",
                  "bank"))
    reg.add(
        "N4_blank_tax_to_zero",
        lambda s, d: t.ledger(s, d).select("order_id", money.tax_to_paise(
            F.when(_k() % 2 == 0, " ").otherwise(money.inr_text(F.col("tax_amount")))).alias("tax")),
        with_ctes("SELECT order_id, CASE WHEN ingest_seq % 2 = 0 THEN 0 ELSE tax_amount END AS tax FROM ledger",
                  "ledger"))
    reg.add(
        "N5_reference_key",
        lambda s, d: t.ledger(s, d).select(
            "order_id", text.reference_key(F.concat(F.lit("  "), F.lower("customer_reference"))).alias("key")),
        with_ctes("SELECT order_id, customer_reference AS key FROM ledger", "ledger"))
    reg.add(
        "N6_reference_from_description",
        lambda s, d: t.bank(s, d).select(
            "settlement_id", text.settlement_key(F.col("utr_reference"), F.col("description")).alias("key")),
        with_ctes("SELECT settlement_id, key FROM bank_key", "bank_key"))
    reg.add(
        "N7_group_reference",
        lambda s, d: t.bank(s, d).select("settlement_id", text.group_reference(F.col("description")).alias("ref")),
        with_ctes(r"""SELECT settlement_id, coalesce(nullif(regexp_extract(upper(description), 'REF\d+', 0), ''),
            upper(trim(description))) AS ref FROM bank""", "bank"))

    def fee(name, fn, sql):
        reg.add(name, lambda s, d: t.ledger(s, d).select("order_id", fn(F.col("expected_amount")).alias("paise")),
                with_ctes(f"SELECT order_id, {sql} AS paise FROM ledger", "ledger"))

    e = "expected_amount"
    fee("N8_two_step_fee", money.two_step_net, two_step(e))
    fee("N9_one_step_fee", money.one_step_net, one_step(e))
    fee("N10_contract_fee", money.mdr_fee, mdr(e))
    fee("N11_fee_adjusted_amount", lambda c: money.fee_adjusted(c, 1.75),
        f"{e} - CAST(round_even({e} * (CAST(1.75 AS DOUBLE) / CAST(100 AS DOUBLE)), 0) AS BIGINT)")

    def fx(s, d):
        rates = t.ledger(s, d).groupBy("currency", "invoice_date").agg(
            F.when(F.col("currency") == "USD", 80 + F.dayofmonth(F.max("invoice_date")) / 10).otherwise(1.0)
            .alias("rate"))
        return t.ledger(s, d).join(rates, ["currency", "invoice_date"]).select(
            "order_id", money.fx_convert(F.col("expected_amount"), F.col("rate")).alias("paise"))

    reg.add("N12_fx_conversion", fx, with_ctes("""
        SELECT order_id, CAST(round_even(expected_amount * CASE WHEN currency = 'USD'
               THEN 80 + CAST(day(invoice_date) AS DOUBLE) / 10 ELSE CAST(1 AS DOUBLE) END, 0) AS BIGINT) AS paise
        FROM ledger""", "ledger"))
    reg.add(
        "N13_absolute_difference",
        lambda s, d: t.bank(s, d).select(
            "settlement_id", money.difference(F.col("net_amount"), F.col("amount")).alias("paise")),
        with_ctes("SELECT settlement_id, abs(net_amount - amount) AS paise FROM bank", "bank"))
    reg.add(
        "N14_alnum_reference",
        lambda s, d: t.bank(s, d).select(
            "settlement_id", text.alnum_reference(F.concat(F.lit("x-"), F.lower("utr_reference"))).alias("ref")),
        with_ctes("""SELECT settlement_id, coalesce(regexp_replace(regexp_replace(upper('x-' || utr_reference),
            '[^A-Z0-9]', '', 'g'), 'REF0*', 'REF', 'g'), '') AS ref FROM bank""", "bank"))
    reg.add(
        "N15_digit_key",
        lambda s, d: t.bank(s, d).select("settlement_id", text.digit_key(F.col("settlement_id")).alias("digits")),
        with_ctes("""SELECT settlement_id, regexp_replace(regexp_replace(settlement_id, '[^0-9]', '', 'g'), '^0+', '')
            AS digits FROM bank""", "bank"))

    def overlap(s, d):
        b = t.bank(s, d).filter("utr_reference is not null")
        return b.select("settlement_id", F.coalesce(text.numbers_overlap(
            text.number_tokens(F.col("settlement_id"), F.col("description")),
            text.number_tokens(F.col("utr_reference"), F.col("payer_account"))), F.lit(False)).alias("shared"))

    reg.add("N16_number_overlap", overlap, with_ctes(r"""
        SELECT settlement_id, list_has_any(
            list_filter(regexp_extract_all(settlement_id || ' ' || description, '\d+'), lambda x: x NOT IN ('0', '00')),
            list_filter(regexp_extract_all(utr_reference || ' ' || payer_account, '\d+'), lambda x: x NOT IN ('0', '00')))
            AS shared FROM bank WHERE utr_reference IS NOT NULL""", "bank"))

    reg.add("N18_question_entity", lambda s, d: questions(s, d).select(
        "question_id", text.question_entity(F.col("question")).alias("e")).select("question_id", "e.*"),
        with_ctes(rf"""
        SELECT question_id, CASE WHEN stl <> '' THEN 'settlement_id' WHEN ord <> '' THEN 'order_id'
               WHEN ref <> '' THEN 'utr_reference' WHEN contains(lower(question), 'chargeback')
               OR contains(lower(question), 'reversal') THEN 'category_count' ELSE 'general_query' END AS filter_type,
               CASE WHEN stl <> '' THEN stl WHEN ord <> '' THEN ord WHEN ref <> '' THEN ref
               WHEN contains(lower(question), 'chargeback') OR contains(lower(question), 'reversal') THEN 'chargeback'
               ELSE trim(question) END AS value
        FROM (SELECT *, regexp_extract(upper(question), 'STL\d+', 0) AS stl,
                     regexp_extract(upper(question), 'ORD\d+', 0) AS ord,
                     regexp_extract(upper(question), 'REF\d+', 0) AS ref FROM ({QUESTIONS_SQL}))""", "ledger"))
    reg.add(
        "N19_receipt_arithmetic",
        lambda s, d: t.ledger(s, d).select("order_id", store.receipt(
            F.col("expected_amount").cast("decimal(18,0)") / 100).alias("r")).select(
            "order_id", F.col("r.fee").alias("fee"), F.col("r.net").alias("net")),
        with_ctes("""SELECT order_id,
            CAST(CAST(round_even(CAST(expected_amount * 236 AS DOUBLE) / 10000, 0) AS BIGINT) / 100.0 AS DOUBLE) AS fee,
            CAST(CAST(round_even(CAST(expected_amount * 9764 AS DOUBLE) / 10000, 0) AS BIGINT) / 100.0 AS DOUBLE) AS net
            FROM ledger""", "ledger"))
    reg.add(
        "U1_whole_row_distinct",
        lambda s, d: _trimmed(t.table(s, d, "events").select("event_type", "props")).dropDuplicates(),
        "SELECT DISTINCT trim(event_type) AS event_type, trim(props) AS props FROM events")


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*[money.strip(F.col(c)).alias(c) for c in df.columns])


QUESTIONS_SQL = """
    SELECT ingest_seq AS question_id, CASE ingest_seq % 6
        WHEN 0 THEN 'Why is stl' || substr(order_id, 4) || ' open?'
        WHEN 1 THEN 'What happened to ' || lower(order_id) || '?'
        WHEN 2 THEN 'Find payment Ref' || substr(order_id, 4)
        WHEN 3 THEN 'How many chargeback cases of ' || customer_name || '?'
        WHEN 4 THEN 'Summary for ' || customer_name
        ELSE 'Show STL' || substr(order_id, 4) || ' and ' || order_id END AS question FROM ledger"""


def questions(s, d) -> DataFrame:
    """One question per order, of six kinds."""
    tail, k = F.substring("order_id", 4, 9), F.col("ingest_seq") % 6
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    name = F.col("customer_name")
    return t.ledger(s, d).select(
        F.col("ingest_seq").alias("question_id"),
        F.when(k == 0, say("Why is stl", tail, " open?"))
        .when(k == 1, say("What happened to ", F.lower("order_id"), "?"))
        .when(k == 2, say("Find payment Ref", tail))
        .when(k == 3, say("How many chargeback cases of ", name, "?"))
        .when(k == 4, say("Summary for ", name))
        .otherwise(say("Show STL", tail, " and ", F.col("order_id"))).alias("question"))
