"""Literal cases of the rules: amounts, dates, ingestion, exceptions, shortlist, store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import money, stats, text
from tallyforge.operators import adjudicate, classify, matchers, quality, shortlist
from tallyforge.plans import elt, reconcile as rc
from tallyforge.settings import Settings
from tallyforge.sources import generator, ingest, readers, store
from tests import sequential as seq

DAY = dt.date(2026, 7, 2)


def one(spark, column, schema="v string", value="x"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("raw,paise", [
    ("37181.36", 3718136), ("1,23,456.78", 12345678), ("12,34,567.89", 123456789), ("Rs. 500.50", 50050),
    ("₹1,000", 100000), ("invalid_amount", None), ("", None), ("18500000", 18500000), ("-7", -700), ("0.125", 12),
])
def test_amounts(spark, raw, paise):
    assert one(spark, money.amount_to_paise(F.col("v")), value=raw) == paise


def test_amount_units(spark):
    assert one(spark, money.amount_to_paise(F.col("v"), "paise"), value="700") == 700
    assert one(spark, money.amount_to_paise(F.col("v"), "rupees"), value="200000") == 20000000


@pytest.mark.parametrize("raw,day", [
    ("2026-07-02", DAY), ("02/07/2026", DAY), ("02-07-2026", DAY), ("2026/7/2", DAY), ("2026-99-99", None), ("soon", None),
])
def test_dates(spark, raw, day):
    assert one(spark, money.parse_date(F.col("v")), value=raw) == day


def test_money_text(spark):
    assert one(spark, money.inr_text(F.lit(-3636084))) == "-36360.84"
    assert one(spark, money.fx_convert(F.lit(400000), 84.07)) == 33628000
    for gross, fee, net in ((50000, 1180.0, 48820.0), (250000, 5900.0, 244100.0)):
        got = one(spark, store.receipt(F.lit(gross)))
        assert (float(got.fee), float(got.net)) == (fee, net)


@pytest.mark.parametrize("question,kind,value", [
    ("Why is stl0003 open?", "settlement_id", "STL0003"), ("ORD12 please", "order_id", "ORD12"),
    ("about Ref77", "utr_reference", "REF77"), ("any Chargeback?", "category_count", "chargeback"),
    (" how are we ", "general_query", "how are we"),
])
def test_question_entities(spark, question, kind, value):
    assert tuple(one(spark, text.question_entity(F.col("v")), value=question)) == (kind, value)


HEAD = "settlement_id,date,amount,utr_reference,payer_account,fees_deducted,net_amount,description,currency\n"


def bank_csv(tmp_path, body):
    f = tmp_path / "bank.csv"
    f.write_text(HEAD + body, encoding="utf-8")
    return str(f)


def test_bank_ingestion(spark, tmp_path):
    path = bank_csv(tmp_path, (
        'STL0001,2026-07-01,1000.00,REF1,ACC,0,1000.00,ok,INR\n'
        'STL0002,02/07/2026,"1,23,456.78",REF2,ACC,0,"1,23,456.78",ok,INR\n'
        'STL0003,2026-07-01,oops,REF3,ACC,0,1.00,bad amount,INR\n'
        'STL0004,2026-99-99,10.00,REF4,ACC,0,10.00,bad date,INR\n'
        'STL0005,2026-07-01,10.00,,ACC,0,10.00,blank reference,INR\n'))
    got = ingest.ingest(ingest.read_csv(spark, path), ingest.BANK)
    assert tuple(got.stats.first()) == (5, 3, 2, 0)
    rows = {r.settlement_id: r for r in got.rows.collect()}
    assert rows["STL0002"].amount == 12345678 and rows["STL0002"].date == DAY
    assert rows["STL0005"].utr_reference is None and rows["STL0005"].tax_deducted == 0


def test_repeated_rows_and_reused_ids(spark, tmp_path):
    row = "STL0001,2026-07-01,1000.00,REF1,ACC,0,1000.00,{},INR\n"
    path = bank_csv(tmp_path, row.format("ok") * 2 + "STL0002,2026-07-01,1.00,R,ACC,0,1.00,ok,INR\n" + row.format("again"))
    got = ingest.ingest(ingest.read_csv(spark, path), ingest.BANK)
    assert tuple(got.stats.first()) == (4, 2, 1, 1)
    assert got.rows.filter("settlement_id = 'STL0001'").first().description == "ok"


def test_validation_report(spark, tmp_path):
    good = "".join(f"STL000{i},2026-07-01,10.00,R{i},ACC,0,10.00,ok,INR\n" for i in range(5))
    path = bank_csv(tmp_path, good + "STL0009,2026-99-99,10.00,R9,ACC,0,10.00,bad,INR\n")
    rows = ingest.validation_report(ingest.read_csv(spark, path), ingest.BANK).collect()
    assert [(r.line, r.message) for r in rows] == [
        (7, "Row 7 (ID: STL0009): date: Value error, Invalid date format: 2026-99-99")]


def test_gateway_defaults_for_absent_columns(spark, tmp_path):
    f = tmp_path / "gateway.csv"
    f.write_text("order_id,gross_amount,gateway_fee\nORD1,100.00,2.00\nORD2,,1.00\n")
    got = ingest.ingest_gateway(ingest.read_csv(spark, str(f)))
    r = got.rows.first()
    assert (r.payout_id, r.payout_date, r.net_payout, r.status) == ("PAYOUT_1", dt.date(2026, 7, 1), 9800, "SETTLED")
    assert tuple(got.stats.first()) == (2, 1)


def settlement(sid, net, utr="REF100", date=DAY, fees=0, desc="x", payer="ACC", tax=0):
    return dict(settlement_id=sid, date=date, amount=net + fees, utr_reference=utr, payer_account=payer, fees_deducted=fees,
                tax_deducted=tax, net_amount=net, description=desc, currency="INR", ingest_seq=0)


def order(oid, e, ref="REF100", due=DAY, name="Cust", seq_no=0):
    return dict(order_id=oid, invoice_date=DAY, expected_amount=e, customer_name=name, customer_reference=ref,
                expected_settlement_date=due, tax_amount=0, currency="INR", status="unsettled", ingest_seq=seq_no)


def tables(spark, bank, ledger):
    return spark.createDataFrame(bank, schemas.BANK), spark.createDataFrame(ledger, schemas.LEDGER)


def pairs(df):
    return sorted((r.settlement_id, r.order_id, r.rule_applied) for r in df.collect())


def test_reference_phases(spark):
    b, l = tables(spark, [settlement("STL002", 100000), settlement("STL001", 100000)], [order("ORD1", 100000)])
    assert pairs(matchers.match_exact(b, l)) == [("STL001", "ORD1", "EXACT_REFERENCE_MATCH")]
    b, l = tables(spark, [settlement("S", 97640, fees=2360)], [order("O", 100000)])
    assert pairs(matchers.match_exact(b, l)) == []
    assert pairs(matchers.match_tolerance(b, l)) == [("S", "O", "FEE_DEDUCTED_MATCH")]
    for net, date, want in ((100500, DAY, 1), (100501, DAY, 0), (100000, DAY + dt.timedelta(8), 0), (102000, DAY, 0)):
        b, l = tables(spark, [settlement("S", net, date=date)], [order("O", 100000)])
        assert len(pairs(matchers.match_exact_then_tolerance(b, l))) == want


def test_partial_guards(spark):
    bank, ledger = [], []
    for i, (a, c) in enumerate(((0, 0), (-2500, -2500), (30000, 20000))):
        bank += [settlement(f"S{i}a", a, f"REF{i}"), settlement(f"S{i}b", c, f"REF{i}")]
        ledger.append(order(f"O{i}", 100000, f"REF{i}"))
    groups = matchers.partial_groups(*tables(spark, bank, ledger)).collect()
    assert [(g.order_id, g.rule_applied, g.variance_paise) for g in groups] == [
        ("O2", "PARTIAL_SETTLEMENT_SHORTFALL", 47640)]


def test_all_phases_equal_the_sequential_run(spark):
    import random

    bank, ledger, gateway = seq.random_batch(random.Random(21), 80, 60, 25)
    b, l = tables(spark, bank, ledger)
    g = spark.createDataFrame(gateway, schemas.GATEWAY)
    found = rc.match_phases(b, l, g)
    assert pairs(found) == sorted(seq.all_phases(bank, ledger, gateway))
    again = rc.match_phases(b.repartition(7).orderBy(F.rand(1)), l.orderBy(F.rand(2)), g.repartition(3))
    assert pairs(again) == pairs(found)
    left = matchers.unmatched(b, found, "settlement_id")
    assert left.count() + found.select("settlement_id").distinct().count() == len(bank)


def test_exceptions(spark):
    b, _ = tables(spark, [
        settlement("STL0093", -3636084, "REF1"), settlement("STL2", 100, "REF2"), settlement("STL3", 825337, "MISC467737"),
        settlement("STL4", 100, "REF4")], [order("O", 1)])
    settled = spark.createDataFrame([("REF2",)], "utr_reference string")
    pending = spark.createDataFrame([("STL4", "no capacity")], "settlement_id string, pending_reason string")
    got = {r.record_id: r for r in classify.classify_bank(b, settled, pending=pending).collect()}
    assert got["STL0093"].category == "CHARGEBACK_REVERSAL" and "₹36360.84" in got["STL0093"].reason
    assert (got["STL2"].category, got["STL2"].priority) == ("DUPLICATE_SETTLEMENT", "HIGH")
    assert got["STL3"].category == "ORPHAN_BANK_SETTLEMENT" and "₹8253.37" in got["STL3"].reason
    assert (got["STL4"].category, got["STL4"].priority, got["STL4"].is_exception) == ("PENDING_VERIFICATION", "LOW", False)
    _, l = tables(spark, [settlement("S", 1)], [order("O1", 1, due=dt.date(2026, 8, 5)), order("O2", 1, due=DAY)])
    got = {r.record_id: r.category for r in classify.classify_ledger(l, "2026-07-28").collect()}
    assert got == {"O1": "PENDING_SETTLEMENT", "O2": "ORPHAN_LEDGER_ORDER"}


def test_shortlist_cases(spark):
    rec = spark.createDataFrame([("S1", "REF01338908", "Acme"), ("S2", "ZZZ", "Nobody")], "id string, ref string, name string")
    pool = spark.createDataFrame(
        [("O1", "REF1338908", "Acme", 1), ("O2", "REF01338909", "Acme", 2), ("O3", "REF01338907", "Acme", 3),
         ("O4", "QQQQQ", "Else", 4)], "id string, ref string, name string, pos int")
    rows = shortlist.shortlist(rec, pool).orderBy("record_id", "rank").collect()
    assert [r.candidate_id for r in rows] == ["O1", "O2", "O3"] and rows[0].similarity_score > 0.75


def test_shortlist_with_vectors(spark):
    rec = spark.createDataFrame([("S1", "REF100", "A", [1.0, 0.0])], "id string, ref string, name string, vector array<float>")
    pool = spark.createDataFrame(
        [("O1", "REF101", "A", 1, [0.0, 1.0]), ("O2", "REF102", "A", 2, [1.0, 0.0])],
        "id string, ref string, name string, pos int, vector array<float>")
    rows = shortlist.shortlist(rec, pool).orderBy("rank").collect()
    assert [(r.candidate_id, round(r.semantic_score, 2)) for r in rows] == [("O2", 1.0), ("O1", 0.0)]


def test_decisions_and_routing(spark):
    b, l = tables(spark, [
        settlement("STL16", 100000, "REF16"), settlement("STL17", 100000, "REF16", date=DAY + dt.timedelta(1)),
        settlement("STL90", 5, "REF16X")], [order("ORD16", 100000, "REF0016")])
    listed = shortlist.shortlist(shortlist.bank_records(b), shortlist.ledger_records(l))
    rows = adjudicate.candidate_rows(listed, b, l)
    out = {r.settlement_id: r for r in adjudicate.route(adjudicate.decide(rows), b).collect()}
    assert (out["STL16"].outcome, out["STL16"].rule_applied) == ("auto_matched", "ADJUDICATED_DETERMINISTIC_FEES_MATCH")
    assert out["STL17"].outcome == "exception"  # the order went to the earlier settlement
    known = adjudicate.decision_key(rows).filter("settlement_id = 'STL90'").selectExpr(
        "decision_key", """'{"decision":"match","matched_order_id":"ORD16","confidence":0.6,"reasoning":"r","rule_category":"EXT"}' AS payload""")
    valid, bad = adjudicate.parse_decisions(known.unionByName(
        spark.createDataFrame([("k", '{"decision":"match","confidence":7}')], "decision_key string, payload string")))
    assert bad.count() == 1
    out = {r.settlement_id: r.rule_applied for r in adjudicate.route(adjudicate.decide(rows, decisions=valid), b).collect()}
    assert out["STL90"] == "NEEDS_HUMAN_REVIEW_EXT"


def test_generated_batch(spark):
    b, l, g = generator.generate(spark, 10)
    assert (b.count(), l.count(), g.count()) == (580, 680, 550)
    found = rc.match_phases(b, l, g)
    assert found.select("settlement_id").distinct().count() == 550
    assert b.exceptAll(generator.generate(spark, 10)[0]).isEmpty()


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("S", "O")], "settlement_id string, order_id string")
    for i in range(12):
        st.save_snapshot(f"s{i:02d}", "n", dt.datetime(2026, 1, 1 + i), {"audit_log": rows})
    assert [r.id for r in st.snapshots().collect()] == [f"s{i:02d}" for i in range(11, 1, -1)]
    st.delete_snapshot("s11")
    assert st.snapshots().first().id == "s10" and st.restore_snapshot()["audit_log"].count() == 1
    assert st.restore_snapshot("missing") == {}


def test_landing_and_marts(spark):
    raw = spark.createDataFrame([
        ("1", "c1", "2026-01-01", "paid", "100", "2026-01-01"), ("1", "c1", "2026-01-01", "paid", "120", "2026-01-02"),
        ("2", "c1", "2026-01-02", "paid", "75", "2026-01-02"), ("3", "c2", "2026-01-03", "paid", "210", "2026-01-03")],
        "order_id string, customer_id string, order_date string, status string, total_amount string, updated_at string")
    staged = elt.staged_orders(raw)
    assert (raw.count(), staged.count()) == (4, 3)
    assert sorted(r.revenue for r in elt.daily_revenue(staged).collect()) == [75, 120, 210]
    src = spark.createDataFrame([(1, 100.0), (2, 150.0), (3, 200.0)], "order_id int, total_amount double")
    tgt = spark.createDataFrame([(1, 100.0), (2, 150.0), (4, 210.0)], "order_id int, total_amount double")
    assert sorted(tuple(r) for r in quality.key_differences(src, tgt, "order_id").collect()) == [(3, "deleted"), (4, "new")]
    assert {r.metric: r.pct_variance for r in quality.metric_variance(src, tgt, "total_amount").collect()}["sum"] == 2.2222


def test_statistics():
    assert abs(stats.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(stats.t_critical(0.05, 10) - 2.2281) < 1e-3
    assert abs(stats.mcnemar_p(1, 6) - 0.125) < 1e-9 and abs(stats.mcnemar_p(30, 10) - 0.00266) < 1e-4
    assert abs(stats.ks_p(0.2, 100, 100) - 0.0366) < 1e-3 and abs(stats.normal_two_sided(1.96) - 0.05) < 1e-4


def test_reader_dispatch():
    assert [readers.format_of(p) for p in ("a.CSV", "b.jsonl.gz", "c.pq", "d.bin")] == ["csv", "json", "parquet", "binaryFile"]


def test_lookup_values_are_data(spark):
    from tallyforge.plans import analytics

    b, l = tables(spark, [settlement("STL1", 1)], [order("ORD1", 1)])
    q = spark.createDataFrame([(1, "STL1' OR '1'='1"), (2, "STL1"), (3, "%")], "question_id int, value string")
    x = spark.createDataFrame([], schemas.EXCEPTIONS)
    g = spark.createDataFrame([], schemas.GATEWAY)
    assert [tuple(r) for r in analytics.lookups(q, b, x, l, g).collect()] == [(2, "bank", "STL1")]
