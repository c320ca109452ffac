"""Registered queries: evaluation, tax, cash, customers, review desk and lookups (E, T, C, Q, W, P, J, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans import analytics as an
from tallyforge.plans import views
from tallyforge.registry.core import Registry
from tallyforge.registry.intake import QUESTIONS_SQL, questions
from tallyforge.registry.oracle_ctes import AS_OF, inr_text, mdr, one_step, with_ctes
from tallyforge.sources import tables as t

EVALUATION = """
    SELECT round_even(p, 4) AS precision, round_even(r, 4) AS recall,
           round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 1.0 END, 4) AS f1_score,
           round_even(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 1.0 END, 4)
               AS overall_accuracy,
           round_even(matched_settlements / total_settlements, 4) AS match_rate, total_settlements,
           system_matches_count, tp, fp, fn, tn, total_true_matches
    FROM (SELECT *, CAST(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS DOUBLE) AS p,
                 CAST(CASE WHEN total_true_matches > 0 THEN tp / total_true_matches ELSE 1.0 END AS DOUBLE) AS r,
                 greatest(0, total_true_matches - tp) AS fn,
                 CASE WHEN x > 0 THEN x ELSE greatest(0, total_true_matches * 2 - fp) END AS tn
          FROM (SELECT count(*) FILTER (coalesce(is_true_match, false)) AS tp,
                       count(*) FILTER (NOT coalesce(is_true_match, false)) AS fp,
                       count(DISTINCT settlement_id) AS matched_settlements, count(*) AS system_matches_count
                FROM ({predicted})),
               (SELECT {true_total} AS total_true_matches), (SELECT count(*) AS total_settlements FROM bank),
               (SELECT {exceptions} AS x))"""
WITH_TRUTH = "SELECT m.*, g.is_true_match FROM {} m LEFT JOIN truth g USING (settlement_id, order_id)"
TRUE_TOTAL = "(SELECT count(*) FROM truth WHERE is_true_match)"


def _mbl(s, d):
    return views.matches(s, d), t.bank(s, d), t.ledger(s, d)


def _mblx(s, d):
    return (*_mbl(s, d), views.exceptions(s, d))


def _feedback(s, d):
    """Two opinions per seventh settlement; the later one counts."""
    b, k = t.bank(s, d), F.col("ingest_seq")
    word = (
        F.when(k % 4 == 0, "APPROVE").when(k % 4 == 1, "REJECTED").when(k % 4 == 2, "LIKE").otherwise("Resolved"))
    rows = b.filter(k % 7 == 0)
    return rows.select("settlement_id", F.lit("DISLIKE").alias("feedback"), F.lit(1).alias("timestamp")).unionByName(
        rows.select("settlement_id", word.alias("feedback"), F.lit(2).alias("timestamp")))


FEEDBACK_SQL = """CASE WHEN ingest_seq % 7 = 0 THEN CASE ingest_seq % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REJECTED'
    WHEN 2 THEN 'LIKE' ELSE 'Resolved' END END"""


def register(reg: Registry):
    # ---------------------------------------------------------------- evaluation
    reg.add(
        "E1_accuracy_vs_truth",
        lambda s, d: an.evaluate(views.matches(s, d), t.bank(s, d), t.ground_truth(s, d), views.exceptions(s, d)),
        with_ctes(EVALUATION.format(
            predicted=WITH_TRUTH.format("matches"), true_total=TRUE_TOTAL,
            exceptions="(SELECT count(*) FROM exceptions)"), "matches", "truth", "exceptions"))
    reg.add(
        "E2_no_truth_fallback",
        lambda s, d: an.evaluate(views.matches(s, d), t.bank(s, d)),
        with_ctes(EVALUATION.format(
            predicted="SELECT *, true AS is_true_match FROM matches",
            true_total="(SELECT count(*) FROM matches)", exceptions="0"), "matches"))
    reg.add(
        "E3_match_rate",
        lambda s, d: an.evaluate(views.matches(s, d), t.bank(s, d)).select("match_rate", "total_settlements"),
        with_ctes("""SELECT round_even((SELECT count(DISTINCT settlement_id) FROM matches) / count(*), 4) AS match_rate,
            count(*) AS total_settlements FROM bank""", "matches", "bank"))
    reg.add("E4_rule_breakdown", lambda s, d: an.rule_breakdown(views.matches(s, d)),
            with_ctes("SELECT rule_applied, count(*) AS n FROM matches GROUP BY 1", "matches"))
    reg.add(
        "E5_batch_summary",
        lambda s, d: an.batch_summary(views.matches(s, d), t.bank(s, d), F.lit(3), F.lit(2)),
        with_ctes("""SELECT total_bank_settlements, matched_count,
            round_even(matched_count / total_bank_settlements * 100, 2) AS match_rate_percent,
            CAST(3 AS BIGINT) AS needs_review_count, CAST(2 AS BIGINT) AS pending_verification_count,
            greatest(0, total_bank_settlements - matched_count - 3) AS exception_count
            FROM (SELECT count(*) AS total_bank_settlements FROM bank),
                 (SELECT count(*) AS matched_count FROM matches)""", "matches", "bank"))
    half = lambda cte, stage: (
        f"SELECT *, '{stage}' AS stage FROM ("
        + EVALUATION.format(predicted=WITH_TRUTH.format(cte), true_total=TRUE_TOTAL, exceptions="0") + ")")
    reg.add(
        "E6_baseline_vs_full",
        lambda s, d: an.baseline_and_full(views.matches(s, d), t.bank(s, d), t.ground_truth(s, d)),
        with_ctes(half("found3", "baseline") + " UNION ALL " + half("matches", "full"), "matches", "truth"))
    reg.add(
        "E7_effort_saved", lambda s, d: an.effort_saved(t.bank(s, d), 12.5),
        with_ctes("""SELECT n AS total_records, round_even(n / 12.5, 1) AS records_per_second,
            round_even(n * CAST(4.5 AS DOUBLE) / 60, 2) AS manual_hours_equivalent,
            round_even((1.0 - 12.5 / greatest(1.0, n * 270)) * 100, 2) AS time_saved_percent
            FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM bank)""", "bank"))
    reg.add("E8_exceptions_by_category", lambda s, d: an.exceptions_by_category(views.exceptions(s, d)),
            with_ctes("SELECT category, count(*) AS n FROM exceptions GROUP BY 1", "exceptions"))

    def shares(s, d):
        m, x = views.matches(s, d), views.exceptions(s, d)
        return an.outcome_shares(m, x.filter("priority = 'LOW'"), x.filter("priority <> 'LOW'"))

    reg.add("E9_outcome_shares", shares, with_ctes("""
        SELECT label, n, round_even(n / sum(n) OVER () * 100, 2) AS share_percent FROM (
            SELECT 'Auto-Matched' AS label, count(*) AS n FROM matches
            UNION ALL SELECT 'Needs Review', count(*) FROM exceptions WHERE priority = 'LOW'
            UNION ALL SELECT 'Exceptions', count(*) FROM exceptions WHERE priority <> 'LOW')""",
        "matches", "exceptions"))
    reg.add("E10_category_count", lambda s, d: an.category_count(views.exceptions(s, d), t.bank(s, d), "chargeback"),
            with_ctes("SELECT category, count(*) AS n FROM exceptions WHERE category ILIKE '%chargeback%' GROUP BY 1",
                      "exceptions"))
    reg.add(
        "E10_category_count_fallback",
        lambda s, d: an.category_count(
            views.exceptions(s, d).filter("category not like 'CHARGEBACK%'"), t.bank(s, d), "reversal"),
        with_ctes("""SELECT CAST(NULL AS VARCHAR) AS category, count(*) AS n FROM bank
            WHERE net_amount < 0 OR description ILIKE '%reversal%'""", "bank"))

    # ---------------------------------------------------------------- tax
    tax = f"""
        SELECT settlement_id AS record_id, order_id, 'bank_settlement' AS source,
               CASE WHEN fee > contract + tol THEN 'PLATFORM_FEE_OVERCHARGE' ELSE 'TAX_LEAKAGE_MISMATCH' END AS category,
               'HIGH' AS priority,
               'Tax/Fee deduction shortfall on order ' || order_id || ': Bank net credit Rs ' || {inr_text('net')}
               || ' vs Expected Rs ' || {inr_text('x')} || '. Shortfall: Rs ' || {inr_text('abs(net - x)')} || '.' AS reason,
               'Raise tax adjustment dispute with payment gateway for order ' || order_id || ' to recover Rs '
               || {inr_text('abs(net - x)')} || ' tax leakage.' AS suggested_action
        FROM (SELECT *, expected_amount - CASE WHEN fee <> 0 THEN fee ELSE contract END AS x,
                     least(CAST(round_even(expected_amount * CAST(0.001 AS DOUBLE), 0) AS BIGINT), 1000) AS tol
              FROM (SELECT settlement_id, order_id, expected_amount, net_amount AS net, fees_deducted AS fee,
                           {mdr('expected_amount')} AS contract FROM audited WHERE expected_amount > 0))
        WHERE abs(net - x) > tol"""
    reg.add("T1_tax_line_audit", lambda s, d: an.tax_line_audit(*_mbl(s, d)), with_ctes(tax, "audited"))
    items = """SELECT settlement_id, order_id, customer_name, amount / 100.0 AS gross_amount_inr,
        CAST(round_even(amount * CAST(2.0 AS DOUBLE) / 100, 0) AS BIGINT) / 100.0 AS platform_fee_inr,
        CAST(round_even(amount * CAST(18.0 AS DOUBLE) / 100, 0) AS BIGINT) / 100.0 AS gst_amount_inr,
        CAST(0.0 AS DOUBLE) AS tds_withheld_inr, net_amount / 100.0 AS net_bank_credit_inr,
        'CLEAN_TAX_VERIFIED' AS audit_status FROM audited"""
    reg.add("T2_tax_line_items", lambda s, d: an.tax_line_items(*_mbl(s, d)), with_ctes(items, "audited"))
    reg.add("T2_tax_line_items_all", lambda s, d: an.tax_line_items(*_mbl(s, d), limit=None),
            with_ctes(items, "audited"))
    reg.add("T3_verified_tax_percent", lambda s, d: an.verified_tax_percent(*_mbl(s, d)), with_ctes(f"""
        SELECT n AS total_reconciled_matches, bad AS tax_leakage_mismatches_count,
               round_even((n - bad) / n * 100, 1) AS verified_tax_percent
        FROM (SELECT count(*) AS n FROM audited),
             (SELECT count(*) FILTER (category = 'TAX_LEAKAGE_MISMATCH') AS bad FROM ({tax}))""", "audited"))

    # ---------------------------------------------------------------- customers and cash
    reg.add("C1_settlement_lags", lambda s, d: an.settlement_lags(*_mbl(s, d)), with_ctes("""
        SELECT customer_name, order_id, CAST(greatest(0, date - invoice_date) AS DOUBLE) AS lag_days FROM audited""",
        "audited"))

    def at_risk(s, d):
        m, b, l, x = _mblx(s, d)
        return an.open_orders(m, l, x, views.AS_OF).groupBy("customer_name").agg(
            F.count_if("is_risk").alias("violations"), F.sum("expected_amount").alias("outstanding"),
            F.coalesce(F.sum(F.when(F.col("is_risk"), F.col("expected_amount"))), F.lit(0)).alias("at_risk"),
            F.max("late_days").cast("long").alias("latest"))

    reg.add("C2_open_orders_at_risk", at_risk, with_ctes("""
        SELECT customer_name, count(*) FILTER (is_risk) AS violations,
               CAST(sum(expected_amount) AS BIGINT) AS outstanding,
               CAST(coalesce(sum(expected_amount) FILTER (is_risk), 0) AS BIGINT) AS at_risk,
               CAST(max(late_days) AS BIGINT) AS latest
        FROM open_orders GROUP BY 1""", "open_orders"))
    reg.add("C3_customer_reliability", lambda s, d: an.customer_scores(*_mblx(s, d), views.AS_OF),
            with_ctes("SELECT * FROM scores", "scores"))
    reg.add("C4_customer_ranking", lambda s, d: an.rank_customers(
        an.customer_scores(*_mblx(s, d), views.AS_OF)).select(
        "customer_name", "default_violations_count", "at_risk_amount_inr"), with_ctes("""
        SELECT customer_name, default_violations_count, at_risk_amount_inr FROM scores""", "scores"))
    reg.add(
        "C5_collection_weights", lambda s, d: an.collection_weights(views.matches(s, d), t.ledger(s, d)),
        with_ctes("""SELECT greatest(CAST(0.70 AS DOUBLE), least(CAST(0.95 AS DOUBLE), round_even(
            (SELECT count(*) FROM matches) / count(*), 3))) AS expected_collection_weight,
            CAST(0.25 AS DOUBLE) AS at_risk_recovery_weight FROM ledger""", "matches", "ledger"))
    reg.add("C6_confirmed_cash", lambda s, d: an.confirmed_cash(*_mbl(s, d))[0], with_ctes("""
        SELECT order_id, settlement_id, customer_name, CAST(date AS VARCHAR) AS date, net_amount / 100.0 AS amount_inr,
               'CONFIRMED_CREDIT' AS status
        FROM audited""", "audited"))
    reg.add("C7_inflow_orders", lambda s, d: an.inflow_orders(*_mblx(s, d), views.AS_OF).select(
        "order_id", "inr_paise", "due_date", "days_ahead", "bucket", "risk_reason", "is_risk"), with_ctes("""
        SELECT order_id, inr_paise, CAST(due_date AS VARCHAR) AS due_date, days_ahead, bucket, risk_reason, is_risk
        FROM inflow""", "inflow"))
    reg.add(
        "C8_usd_exposure",
        lambda s, d: an.inflow_orders(*_mblx(s, d), views.AS_OF).filter("is_usd").agg(
            F.sum("expected_amount").alias("usd_cents"), F.sum("inr_paise").alias("inr_paise"),
            F.count("*").alias("n")),
        with_ctes("""SELECT CAST(sum(expected_amount) AS BIGINT) AS usd_cents, CAST(sum(inr_paise) AS BIGINT) AS inr_paise,
            count(*) AS n FROM inflow WHERE is_usd""", "inflow"))
    reg.add("C9_cash_forecast", lambda s, d: an.cash_forecast(*_mblx(s, d), views.AS_OF),
            with_ctes("SELECT * FROM forecast", "forecast"))

    def stressed(s, d):
        delays = t.table(s, d, "nation").select(
            F.col("n_nationkey").alias("delay_days"), (F.col("n_regionkey") * 20).alias("recovery_percent"))
        return an.stress(an.cash_forecast(*_mblx(s, d), views.AS_OF), delays)

    reg.add("C10_what_if_stress", stressed, with_ctes("""
        SELECT delay_days, recovery_percent, round(inflow, 2) AS simulated_30d_inflow_inr,
               round(recovered, 2) AS simulated_recovery_inr,
               round(confirmed_bank_cash_inr + inflow * expected_collection_weight + recovered, 2)
               AS simulated_conservative_inr
        FROM (SELECT n_nationkey AS delay_days, n_regionkey * 20 AS recovery_percent, f.*,
                     greatest(0.0, projected_30d_inflow_inr * (1 - n_nationkey * CAST(0.02 AS DOUBLE))) AS inflow,
                     at_risk_receivables_30d_inr * (n_regionkey * 20 / 100) AS recovered
              FROM nation, forecast f)""", "forecast"))

    # ---------------------------------------------------------------- review desk
    sla = f"""
        SELECT m.settlement_id, m.order_id, m.rule_applied, m.confidence,
               CASE WHEN fb IN ('LIKE', 'APPROVE', 'APPROVED') THEN 'HUMAN_APPROVED'
                    WHEN fb IN ('DISLIKE', 'REJECT', 'REJECTED') THEN 'HUMAN_REJECTED'
                    WHEN starts_with(m.rule_applied, 'EXACT') OR m.confidence >= 0.95 THEN 'MEETS_SLA'
                    WHEN m.confidence >= 0.85 THEN 'SLA_WARNING_24H' ELSE 'SLA_BREACH_48H' END AS sla_status
        FROM matches m JOIN (SELECT settlement_id, {FEEDBACK_SQL} AS fb FROM bank) USING (settlement_id)"""
    reg.add("Q1_sla_tags", lambda s, d: an.sla_tags(views.matches(s, d), _feedback(s, d)),
            with_ctes(sla, "matches"))
    reg.add("J5_latest_feedback", lambda s, d: an.latest_feedback(_feedback(s, d)), with_ctes(
        f"SELECT settlement_id, {FEEDBACK_SQL} AS feedback FROM bank WHERE ingest_seq % 7 = 0", "bank"))
    reg.add("J3_audit_join", lambda s, d: an.audited(*_mbl(s, d)).select(
        "settlement_id", "order_id", "net_amount", "expected_amount", "customer_name"), with_ctes(
        "SELECT settlement_id, order_id, net_amount, expected_amount, customer_name FROM audited", "audited"))
    reg.add("J6_prediction_vs_truth", lambda s, d: an.predictions(views.matches(s, d), t.ground_truth(s, d)).select(
        "settlement_id", "order_id", "is_true"), with_ctes(
        "SELECT settlement_id, order_id, coalesce(is_true_match, false) AS is_true FROM ("
        + WITH_TRUTH.format("matches") + ")", "matches", "truth"))
    reg.add("W4_newest_matches", lambda s, d: an.newest_matches(views.matches(s, d)).select(
        "settlement_id", "order_id", "phase"), with_ctes(
        "SELECT settlement_id, order_id, phase FROM matches", "matches"))
    reg.add("W3_latest_n_credits", lambda s, d: t.bank(s, d).orderBy(F.desc("date"), "settlement_id").limit(25).select(
        "settlement_id", "date", "net_amount"), with_ctes("""
        SELECT settlement_id, CAST(date AS VARCHAR) AS date, net_amount FROM bank
        ORDER BY bank.date DESC, settlement_id LIMIT 25""", "bank"))
    reg.add("W2_top_k_per_settlement", lambda s, d: views.adjudicated(s, d).candidates.filter("rank <= 2").select(
        "settlement_id", "order_id", "rank", "similarity_score"))
    reg.add("W5_priority_sort", lambda s, d: an.by_priority(views.exceptions(s, d)).select(
        "record_id", "priority"), with_ctes("SELECT record_id, priority FROM exceptions", "exceptions"))
    reg.add("W6_alphabetic_priority_sort", lambda s, d: an.summary_exceptions(views.exceptions(s, d)), with_ctes(
        "SELECT record_id, priority, category, reason, suggested_action FROM exceptions", "exceptions"))
    cols = ["settlement_id", "order_id", "rule_applied", "reason"]

    def searched(s, d):
        from tallyforge.plans.reconcile import with_reasons

        m = with_reasons(views.matches(s, d), t.bank(s, d), t.ledger(s, d))
        return an.search(m, "Shortfall", cols).select("settlement_id", "order_id")

    reg.add("P1_search_matches", searched, with_ctes(
        "SELECT settlement_id, order_id FROM matches WHERE rule_applied ILIKE '%shortfall%'", "matches"))

    def open_search(s, d):
        x = views.exceptions(s, d)
        resolved = an.latest_feedback(_feedback(s, d)).filter("feedback = 'Resolved'").select(
            F.col("settlement_id").alias("record_id"))
        return an.search_open_exceptions(x, resolved, "DUPLICATE").select("record_id", "category")

    reg.add("P2_search_open_exceptions", open_search, with_ctes(f"""
        SELECT record_id, category FROM exceptions WHERE (category ILIKE '%duplicate%' OR reason ILIKE '%duplicate%'
               OR suggested_action ILIKE '%duplicate%') AND record_id NOT IN (
            SELECT settlement_id FROM bank WHERE {FEEDBACK_SQL} = 'Resolved')""", "exceptions"))

    # ---------------------------------------------------------------- lookups
    reg.add("J4_L1_lookup_context", lambda s, d: an.lookup_context(
        t.bank(s, d), views.matches(s, d), t.ledger(s, d), views.exceptions(s, d)).select(
        "settlement_id", "order_id", "rule_applied", "exception_category", "reference_match", "reference_note",
        "customer_name_match", "gross_difference_inr", "net_vs_expected_difference_inr"), with_ctes(f"""
        SELECT settlement_id, order_id, rule_applied, x.category AS exception_category,
               CASE WHEN e IS NOT NULL THEN same END AS reference_match,
               CASE WHEN e IS NOT NULL THEN 'Bank reference ''' || br || CASE WHEN same
                    THEN ''' and Ledger customer reference ''' ELSE ''' vs Ledger customer reference ''' END || lr || ''''
                    || CASE WHEN same THEN ' match perfectly.' WHEN br <> '' AND lr <> ''
                       THEN ' — references differ.' ELSE '.' END END AS reference_note,
               CASE WHEN customer_name IS NOT NULL THEN lower(trim(payer_account)) = lower(trim(customer_name)) END
                    AS customer_name_match,
               (amount - e) / 100.0 AS gross_difference_inr,
               (net_amount - {one_step('e')}) / 100.0 AS net_vs_expected_difference_inr
        FROM (SELECT *, br <> '' AND lr <> '' AND upper(br) = upper(lr) AS same FROM (
            SELECT b.*, m.order_id, m.rule_applied, l.expected_amount AS e, l.customer_name,
                   trim(coalesce(b.utr_reference, '')) AS br, trim(coalesce(l.customer_reference, '')) AS lr
            FROM bank b LEFT JOIN matches m USING (settlement_id) LEFT JOIN ledger l ON l.order_id = m.order_id)) q
        LEFT JOIN exceptions x ON x.record_id = q.settlement_id""", "exceptions", "matches"))
    reg.add(
        "P4_in_list_lookup",
        lambda s, d: an.lookup_many(
            t.bank(s, d), views.exceptions(s, d).select(F.col("record_id").alias("settlement_id"))).select(
            "settlement_id", "net_amount"),
        with_ctes("SELECT settlement_id, net_amount FROM free_bank", "free_bank"))

    def values(s, d):
        from tallyforge.functions import text

        return questions(s, d).select("question_id", text.question_entity(F.col("question"))["value"].alias("value"))

    def looked_up(s, d):
        return an.lookups(
            values(s, d), t.bank(s, d), views.exceptions(s, d), t.ledger(s, d), t.gateway(s, d))

    found_sql = rf"""
        q AS (SELECT question_id, coalesce(nullif(regexp_extract(upper(question), 'STL\d+', 0), ''),
                     nullif(regexp_extract(upper(question), 'ORD\d+', 0), ''),
                     nullif(regexp_extract(upper(question), 'REF\d+', 0), ''), question) AS value
              FROM ({QUESTIONS_SQL})),
        hits AS (SELECT DISTINCT question_id, 1 AS turn, 'bank' AS source, settlement_id AS record_id FROM q
                   JOIN bank ON value IN (settlement_id, utr_reference)
                 UNION ALL SELECT question_id, 2, 'exception', record_id FROM q JOIN exceptions ON value = record_id
                 UNION ALL SELECT question_id, 3, 'ledger', order_id FROM q
                   JOIN ledger ON value IN (order_id, customer_reference)
                 UNION ALL SELECT DISTINCT question_id, 4, 'gateway', payout_id FROM q
                   JOIN gateway ON value IN (payout_id, order_id, utr_reference))"""
    found_sql = found_sql.replace(
        "JOIN bank ON value IN (settlement_id, utr_reference)",
        "JOIN (SELECT settlement_id, settlement_id AS v FROM bank UNION SELECT settlement_id, utr_reference FROM bank)"
        " ON value = v").replace(
        "JOIN ledger ON value IN (order_id, customer_reference)",
        "JOIN (SELECT order_id, order_id AS v FROM ledger UNION SELECT order_id, customer_reference FROM ledger)"
        " ON value = v").replace(
        "JOIN gateway ON value IN (payout_id, order_id, utr_reference)",
        "JOIN (SELECT payout_id, payout_id AS v FROM gateway UNION SELECT payout_id, order_id FROM gateway"
        " UNION SELECT payout_id, utr_reference FROM gateway) ON value = v")
    base = with_ctes("", "bank", "ledger", "gateway", "exceptions")
    reg.add("P3_P5_point_lookups", looked_up, base + "," + found_sql + """
        SELECT question_id, source, record_id FROM hits JOIN (
            SELECT question_id, min(turn) AS turn FROM hits GROUP BY 1) USING (question_id, turn)""")
    counts = lambda s, d: an.general_summary(
        t.bank(s, d), t.ledger(s, d), views.matches(s, d), views.exceptions(s, d))
    counts_sql = """SELECT *, round_even(reconciled_matches_count / total_bank_settlements * 100, 2)
            AS match_rate_percent FROM (SELECT count(*) AS total_bank_settlements FROM bank),
            (SELECT count(*) AS total_internal_orders FROM ledger),
            (SELECT count(*) AS reconciled_matches_count FROM matches),
            (SELECT count(*) AS unresolved_exceptions_count FROM exceptions)"""
    reg.add("L2_general_summary", counts, with_ctes(counts_sql, "bank", "ledger", "matches", "exceptions"))
    reg.add(
        "L2_summary_listing", lambda s, d: an.summary_listing(counts(s, d), views.exceptions(s, d)),
        with_ctes(f"SELECT c.*, record_id, priority, category FROM exceptions, ({counts_sql}) c",
                  "bank", "ledger", "matches", "exceptions"))

    def answered(s, d):
        b, l, m, x = t.bank(s, d), t.ledger(s, d), views.matches(s, d), views.exceptions(s, d)
        return an.answers(
            questions(s, d), an.lookup_context(b, m, l, x), an.general_summary(b, l, m, x), looked_up(s, d),
            an.category_count(x, b, "chargeback")).select("question_id", "filter_type", "answer")

    reg.add("L3_answers", answered)
