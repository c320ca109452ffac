"""The derived tables and the matching phases as SQL, independent of the Spark code.

On the derived batch a settlement can reach one order at most per phase, so
the greedy rule is "first settlement per order" and plain windows suffice.
"""

from __future__ import annotations

AS_OF = "DATE '2001-01-01'"
TWO_STEP = (
    "({e} - CAST(round_even({e} * CAST(0.02 AS DOUBLE), 0) AS BIGINT)"
    " - CAST(round_even(CAST(round_even({e} * CAST(0.02 AS DOUBLE), 0) AS BIGINT) * CAST(0.18 AS DOUBLE), 0) AS BIGINT))"
)
MDR = "CAST(round_even({e} * CAST(0.02 AS DOUBLE), 0) AS BIGINT)"
GST = "CAST(round_even(" + MDR + " * CAST(0.18 AS DOUBLE), 0) AS BIGINT)"
ONE_STEP = "({e} - CAST(round_even({e} * CAST(0.0236 AS DOUBLE), 0) AS BIGINT))"


def mdr(e):
    return MDR.format(e=e)


def gst(e):
    return GST.format(e=e)


def two_step(e):
    return TWO_STEP.format(e=e)


def one_step(e):
    return ONE_STEP.format(e=e)


def inr_text(p):
    return (
        f"(CASE WHEN ({p}) < 0 THEN '-' ELSE '' END || CAST(abs({p}) // 100 AS VARCHAR) || '.'"
        f" || lpad(CAST(abs({p}) % 100 AS VARCHAR), 2, '0'))")


def rupees(p):
    return f"('₹' || {inr_text(p)})"


_BANK_COLS = "settlement_id, date, net_amount, fees_deducted, utr_reference, payer_account, description, currency, ingest_seq"


def _row(where, net, fees="0", utr="ref", date="due", text="'Payout credit'", prefix="STL"):
    return (
        f"SELECT '{prefix}' || code AS settlement_id, {date} AS date, CAST({net} AS BIGINT) AS net_amount,"
        f" CAST({fees} AS BIGINT) AS fees_deducted, {utr} AS utr_reference,"
        f" 'ACC' || o_custkey AS payer_account, {text} AS description, currency, o_orderkey AS ingest_seq"
        f" FROM o WHERE NOT is_split AND {where}")


_rows = [
    _row("k <= 2", "e"),
    _row("k = 3", "e", text="'Credit for ORD' || code"),
    _row("k = 4", "e", text="'Payout PAYOUT' || code"),
    _row("k = 5", "e", utr="CAST(NULL AS VARCHAR)", text="'Settlement for ' || ref"),
    _row("k BETWEEN 6 AND 9", "net2", fees="e - net2"),
    _row("k = 10", "e - fee3", fees="fee3"),
    _row("k = 11", "e + 400"),
    _row("k = 12", "e + 501"),
    _row("k = 13", "e", date="due + 10"),
    _row("k = 14", "e // 2"),
    _row("k = 14", "e - e // 2", prefix="STX"),
    _row("k = 15", "e * 3 // 10"),
    _row("k = 15", "e * 2 // 10", prefix="STX"),
    _row("k = 16", "e", utr="'REF' || o_orderkey"),
    _row("k = 17", "e"),
    _row("k = 17", "-(e // 10)", text="'Chargeback reversal'", prefix="STX"),
    _row("k = 18", "e"),
    _row("k = 18", "e", date="due + 1", prefix="STX"),
]
_split = (
    "SELECT 'STC' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), max(due), CAST(sum(e) AS BIGINT), CAST(0 AS BIGINT),"
    " CAST(NULL AS VARCHAR), customer_name, 'Payout credit', 'INR', o_custkey FROM o WHERE is_split"
    " GROUP BY o_custkey, customer_name")

# name -> (needed CTEs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "o": ([], f"""
        SELECT *, {two_step('e')} AS net2,
               CAST(round_even(e * CAST(0.03 AS DOUBLE), 0) AS BIGINT) AS fee3, 'REF' || code AS ref
        FROM (SELECT o_orderkey, o_custkey, c_name AS customer_name,
                     CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS e,
                     CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 2 AS due,
                     CASE WHEN o_orderkey % 50 = 0 THEN 'USD' ELSE 'INR' END AS currency,
                     o_custkey % 10 = 0 AS is_split, o_orderkey % 20 AS k,
                     lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS code
              FROM orders JOIN customer ON o_custkey = c_custkey)"""),
    "ledger": (["o"], """
        SELECT 'ORD' || code AS order_id, invoice_date, e AS expected_amount, customer_name,
               CASE WHEN NOT is_split THEN ref END AS customer_reference, due AS expected_settlement_date,
               CAST(round_even(e * CAST(0.18 AS DOUBLE), 0) AS BIGINT) AS tax_amount, currency,
               'unsettled' AS status, o_orderkey AS ingest_seq FROM o"""),
    "bank": (["o"], f"""
        SELECT settlement_id, date, net_amount + fees_deducted AS amount, utr_reference, payer_account,
               fees_deducted, CAST(0 AS BIGINT) AS tax_deducted, net_amount, description, currency, ingest_seq
        FROM ({' UNION ALL '.join(_rows)} UNION ALL {_split}) AS t({_BANK_COLS})"""),
    "gateway": (["o"], f"""
        SELECT 'PAYOUT' || code AS payout_id, due AS payout_date, 'ORD' || code AS order_id, ref AS utr_reference,
               e AS gross_amount, {mdr('e')} AS gateway_fee, {gst('e')} AS gateway_tax, net2 AS net_payout,
               'SETTLED' AS status, o_orderkey AS ingest_seq
        FROM o WHERE NOT is_split AND o_orderkey % 7 = 0"""),
    "truth": (["o"], """
        SELECT 'STL' || code AS settlement_id, 'ORD' || code AS order_id, k <> 12 AS is_true_match
        FROM o WHERE NOT is_split AND k <> 19
        UNION ALL SELECT 'STX' || code, 'ORD' || code, true FROM o WHERE NOT is_split AND k IN (14, 15)
        UNION ALL SELECT 'STC' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), 'ORD' || code, true FROM o WHERE is_split"""),
    "bank_key": (["bank"], r"""
        SELECT *, upper(trim(coalesce(nullif(utr_reference, ''),
               nullif(regexp_extract(description, '(?i)\b(REF\d+)\b', 1), '')))) AS key FROM bank"""),
    "pairs": (["bank_key", "ledger"], f"""
        SELECT b.settlement_id, b.date, b.net_amount, b.fees_deducted, l.order_id, l.expected_amount,
               abs(b.date - l.expected_settlement_date) AS days, {two_step('l.expected_amount')} AS net2
        FROM bank_key b JOIN ledger l ON b.key = upper(trim(l.customer_reference))"""),
    "m2": (["pairs"], """
        SELECT settlement_id, order_id, 'EXACT_REFERENCE_MATCH' AS rule_applied FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY date, settlement_id) AS rn FROM pairs
            WHERE days <= 3 AND abs(net_amount - expected_amount) <= 500) WHERE rn = 1"""),
    "m3_alone": (["pairs"], """
        SELECT settlement_id, order_id, CASE WHEN fee THEN 'FEE_DEDUCTED_MATCH' ELSE 'ROUNDING_TOLERANCE_MATCH' END
               AS rule_applied FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY date, settlement_id) AS rn FROM (
                SELECT *, abs(net_amount - net2) <= 500 OR (fees_deducted > 0 AND
                          abs(net_amount - (expected_amount - fees_deducted)) <= 500) AS fee FROM pairs
                WHERE days <= 3) WHERE fee OR abs(net_amount - expected_amount) <= 500) WHERE rn = 1"""),
    "m3": (["pairs", "m2"], """
        SELECT settlement_id, order_id, CASE WHEN fee THEN 'FEE_DEDUCTED_MATCH' ELSE 'ROUNDING_TOLERANCE_MATCH' END
               AS rule_applied FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY date, settlement_id) AS rn FROM (
                SELECT *, abs(net_amount - net2) <= 500 OR (fees_deducted > 0 AND
                          abs(net_amount - (expected_amount - fees_deducted)) <= 500) AS fee FROM pairs
                WHERE days <= 3 AND settlement_id NOT IN (SELECT settlement_id FROM m2)
                  AND order_id NOT IN (SELECT order_id FROM m2))
            WHERE fee OR abs(net_amount - expected_amount) <= 500) WHERE rn = 1"""),
    "found3": (["m2", "m3"], "SELECT * FROM m2 UNION ALL SELECT * FROM m3"),
}


def _partial(bank_where, ledger_where):
    return f"""
        SELECT s.settlement_id, g.order_id, g.rule_applied FROM (
            SELECT settlement_id, {GROUP_REF} AS ref FROM bank {bank_where}) s
        JOIN (
            SELECT ref, order_id, CASE WHEN abs(total - e) <= 500 OR abs(total - net2) <= 500
                   THEN 'PARTIAL_SETTLEMENT_MATCH' WHEN total > 0 THEN 'PARTIAL_SETTLEMENT_SHORTFALL' END
                   AS rule_applied FROM (
                SELECT b.ref, l.order_id, l.e, {two_step('l.e')} AS net2, b.total FROM (
                    SELECT {GROUP_REF} AS ref, count(*) AS n, CAST(sum(net_amount) AS BIGINT) AS total
                    FROM bank {bank_where} GROUP BY 1) b
                JOIN (SELECT {ORDER_REF} AS ref, arg_max(order_id, ingest_seq) AS order_id,
                             arg_max(expected_amount, ingest_seq) AS e FROM ledger {ledger_where} GROUP BY 1) l
                ON b.ref = l.ref WHERE b.n >= 2)) g
        ON s.ref = g.ref WHERE g.rule_applied IS NOT NULL"""


def _extract(c):
    up = f"upper(trim({c}))"
    return f"coalesce(nullif(regexp_extract({up}, 'REF\\d+', 0), ''), nullif({up}, ''))"


GROUP_REF = (
    f"CASE WHEN contains(upper(description), 'REF') THEN {_extract('description')}"
    f" WHEN contains(upper(utr_reference), 'REF') THEN {_extract('utr_reference')}"
    f" ELSE coalesce({_extract('utr_reference')}, {_extract('description')}) END")
ORDER_REF = f"coalesce({_extract('customer_reference')}, {_extract('order_id')})"


def _split_sql(bank_where, ledger_where):
    return f"""
        SELECT w.settlement_id, l.order_id, 'SPLIT_COMBINED_SETTLEMENT_MATCH' AS rule_applied
        FROM (SELECT * FROM ledger {ledger_where}) l JOIN (
            SELECT payer, arg_min(settlement_id, (date, settlement_id)) AS settlement_id FROM (
                SELECT t.payer, b.date, b.settlement_id FROM (SELECT * FROM bank {bank_where}) b JOIN (
                    SELECT upper(trim(customer_name)) AS payer, CAST(sum(expected_amount) AS BIGINT) AS gross
                    FROM ledger {ledger_where} GROUP BY 1 HAVING count(*) >= 2) t
                ON upper(trim(b.payer_account)) = t.payer
                WHERE abs(b.net_amount - gross) <= 500 OR abs(b.net_amount - {two_step('gross')}) <= 500)
            GROUP BY payer) w ON upper(trim(l.customer_name)) = w.payer"""


def _lag(bank_where, ledger_where):
    return f"""
        SELECT settlement_id, order_id, 'TIMING_LAG_MATCH' AS rule_applied FROM (
            SELECT b.settlement_id, l.order_id,
                   row_number() OVER (PARTITION BY l.order_id ORDER BY b.date, b.settlement_id) AS rn
            FROM (SELECT * FROM bank {bank_where}) b JOIN (SELECT * FROM ledger {ledger_where}) l
            ON upper(trim(b.utr_reference)) = upper(trim(l.customer_reference))
            WHERE abs(b.net_amount - l.expected_amount) <= 500
               OR abs(b.net_amount - {one_step('l.expected_amount')}) <= 500) WHERE rn = 1"""


def _free(*found):
    b = " AND ".join(f"settlement_id NOT IN (SELECT settlement_id FROM {f})" for f in found)
    l = " AND ".join(f"order_id NOT IN (SELECT order_id FROM {f})" for f in found)
    return f"WHERE {b}", f"WHERE {l}"


CTES.update({
    "m5_alone": (["bank", "ledger"], _partial("", "")),
    "m5": (["bank", "ledger", "found3"], _partial(*_free("found3"))),
    "m7_alone": (["bank", "ledger"], _split_sql("", "")),
    "m7": (["bank", "ledger", "found3", "m5"], _split_sql(*_free("found3", "m5"))),
    "m8_alone": (["bank", "ledger"], _lag("", "")),
    "m8": (["bank", "ledger", "found3", "m5", "m7"], _lag(*_free("found3", "m5", "m7"))),
    "matches": (["found3", "m5", "m7", "m8"], """
        SELECT *, CASE rule_applied WHEN 'PARTIAL_SETTLEMENT_SHORTFALL' THEN CAST(0.95 AS DOUBLE)
                  WHEN 'TIMING_LAG_MATCH' THEN CAST(0.9 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence,
               CASE rule_applied WHEN 'EXACT_REFERENCE_MATCH' THEN 2 WHEN 'FEE_DEDUCTED_MATCH' THEN 3
                  WHEN 'ROUNDING_TOLERANCE_MATCH' THEN 4 WHEN 'PARTIAL_SETTLEMENT_MATCH' THEN 5
                  WHEN 'PARTIAL_SETTLEMENT_SHORTFALL' THEN 6 WHEN 'SPLIT_COMBINED_SETTLEMENT_MATCH' THEN 7
                  ELSE 8 END AS phase
        FROM (SELECT * FROM found3 UNION ALL SELECT * FROM m5 UNION ALL SELECT * FROM m7 UNION ALL SELECT * FROM m8)"""),
    "m1": (["bank", "ledger", "gateway"], f"""
        SELECT settlement_id, order_id, 'GATEWAY_3WAY_TRIANGULATION_MATCH' AS rule_applied FROM (
            SELECT b.settlement_id, l.order_id,
                   row_number() OVER (PARTITION BY l.order_id ORDER BY b.date, b.settlement_id) AS rn
            FROM (SELECT DISTINCT settlement_id, payout_id, order_id, net_payout FROM (
                    SELECT settlement_id, 'U' || utr_reference AS link FROM bank
                    UNION ALL SELECT settlement_id, 'P' || settlement_id FROM bank
                    UNION ALL SELECT settlement_id, 'P' || utr_reference FROM bank
                    UNION ALL SELECT settlement_id, 'P' || replace(settlement_id, 'STL', 'PAY') FROM bank
                    UNION ALL SELECT settlement_id, 'P' || replace(settlement_id, 'STL', 'PAYOUT') FROM bank
                    UNION ALL SELECT settlement_id, kind || unnest(regexp_extract_all(description, '[A-Za-z0-9]+'))
                    FROM bank, (SELECT unnest(['P', 'O']) AS kind))
                  JOIN (SELECT *, 'U' || utr_reference AS link FROM gateway UNION ALL SELECT *, 'P' || payout_id FROM gateway
                        UNION ALL SELECT *, 'O' || order_id FROM gateway) USING (link)) g
            JOIN bank b ON b.settlement_id = g.settlement_id JOIN ledger l ON g.order_id = l.order_id
            WHERE abs(b.net_amount - g.net_payout) <= 500
               OR abs(b.net_amount - {two_step('l.expected_amount')}) <= 500
               OR abs(b.net_amount - (l.expected_amount - {mdr('l.expected_amount')})) <= 500
               OR abs(b.net_amount - l.expected_amount) <= 500) WHERE rn = 1"""),
    "settled": (["bank", "matches"], """
        SELECT DISTINCT utr_reference FROM bank WHERE utr_reference <> ''
        AND settlement_id IN (SELECT settlement_id FROM matches)"""),
    "free_bank": (["bank", "matches"],
                  "SELECT * FROM bank WHERE settlement_id NOT IN (SELECT settlement_id FROM matches)"),
    "free_ledger": (["ledger", "matches"],
                    "SELECT * FROM ledger WHERE order_id NOT IN (SELECT order_id FROM matches)"),
    "exceptions": (["free_bank", "free_ledger", "settled"], f"""
        SELECT settlement_id AS record_id, 'bank_settlement' AS source,
               CASE WHEN net_amount < 0 THEN 'CHARGEBACK_REVERSAL'
                    WHEN utr_reference IN (SELECT utr_reference FROM settled) THEN 'DUPLICATE_SETTLEMENT'
                    ELSE 'ORPHAN_BANK_SETTLEMENT' END AS category,
               CASE WHEN net_amount < 0 THEN
                      'Bank settlement ' || settlement_id || ' on ' || date || ' has a negative amount of -'
                      || {rupees('abs(net_amount)')} || ' (UTR: ''' || coalesce(utr_reference, '')
                      || '''), indicating a chargeback or reversal.'
                      || CASE WHEN utr_reference IN (SELECT utr_reference FROM settled)
                                OR contains(description, 'Chargeback') OR contains(lower(description), 'reversal')
                         THEN ' Transaction references previously settled UTR '''
                              || coalesce(nullif(utr_reference, ''), description) || '''.' ELSE '' END
                    WHEN utr_reference IN (SELECT utr_reference FROM settled) THEN
                      'Bank settlement ' || settlement_id || ' (' || {rupees('net_amount')} || ', UTR: '''
                      || utr_reference || ''', Date: ' || date || ') is a duplicate entry for UTR ''' || utr_reference
                      || ''' which was already reconciled to an existing order.'
                    ELSE
                      'Bank settlement ' || settlement_id || ' on ' || date || ' (net ' || {rupees('net_amount')}
                      || ', UTR: ''' || coalesce(nullif(utr_reference, ''), nullif(description, ''), 'N/A')
                      || ''', Payer: ''' || payer_account
                      || ''') has no matching candidate in internal ledger for reference '''
                      || coalesce(nullif(utr_reference, ''), nullif(description, ''), 'N/A') || ''' or amount '
                      || {rupees('net_amount')} || '.' END AS reason,
               CASE WHEN net_amount < 0 THEN
                      'Debit merchant ledger account or file chargeback dispute with acquirer bank for UTR '''
                      || coalesce(utr_reference, '') || '''.'
                    WHEN utr_reference IN (SELECT utr_reference FROM settled) THEN 'Flag settlement '
                      || settlement_id
                      || ' as duplicate entry and reverse duplicate credit in bank reconciliation journal.'
                    ELSE 'Contact payment gateway team to verify if order entry for UTR '''
                      || coalesce(nullif(utr_reference, ''), nullif(description, ''), 'N/A')
                      || ''' was omitted from internal ledger.' END AS suggested_action,
               CASE WHEN net_amount < 0 OR utr_reference IN (SELECT utr_reference FROM settled) THEN 'HIGH'
                    ELSE 'MEDIUM' END AS priority, true AS is_exception
        FROM free_bank
        UNION ALL
        SELECT order_id, 'internal_ledger',
               CASE WHEN expected_settlement_date > {AS_OF} THEN 'PENDING_SETTLEMENT' ELSE 'ORPHAN_LEDGER_ORDER' END,
               CASE WHEN expected_settlement_date > {AS_OF} THEN
                      'Internal order ' || order_id || ' (' || {rupees('expected_amount')} || ', Ref: '''
                      || coalesce(customer_reference, 'N/A') || ''') expected settlement date ('
                      || expected_settlement_date || ') is in the future relative to batch date (2001-01-01).'
                    ELSE 'Internal order ' || order_id || ' created on ' || invoice_date || ' (expected '
                      || {rupees('expected_amount')} || ', Customer: ''' || customer_name || ''', Ref: '''
                      || coalesce(customer_reference, 'N/A') || ''') has no matching bank settlement for reference '''
                      || coalesce(customer_reference, 'N/A') || ''' or amount ' || {rupees('expected_amount')} || '.'
                    END,
               CASE WHEN expected_settlement_date > {AS_OF} THEN 'No action required for order ' || order_id
                      || '. Awaiting expected settlement window (' || expected_settlement_date || ').'
                    ELSE 'Verify if customer payment for order ' || order_id
                      || ' failed, was refunded, or was settled under an alternate UTR.' END,
               CASE WHEN expected_settlement_date > {AS_OF} THEN 'LOW' ELSE 'MEDIUM' END,
               expected_settlement_date <= {AS_OF}
        FROM free_ledger"""),
    "audited": (["matches", "bank", "ledger"], """
        SELECT m.*, b.date, b.amount, b.net_amount, b.fees_deducted, b.tax_deducted, b.utr_reference, b.payer_account,
               b.description, l.expected_amount, l.tax_amount, l.customer_name, l.customer_reference, l.invoice_date,
               l.expected_settlement_date, l.currency
        FROM matches m JOIN bank b USING (settlement_id) JOIN ledger l USING (order_id)"""),
    "open_orders": (["free_ledger", "exceptions"], f"""
        SELECT l.*, expected_settlement_date AS due, expected_settlement_date < {AS_OF} AS is_overdue,
               expected_settlement_date < {AS_OF} OR order_id IN (SELECT record_id FROM exceptions) AS is_risk,
               CASE WHEN expected_settlement_date < {AS_OF}
                    THEN greatest(1, {AS_OF} - expected_settlement_date) ELSE 0 END AS late_days
        FROM free_ledger l"""),
    "customer_base": (["audited", "open_orders"], """
        SELECT customer_name, avg(lag_days) AS avg_raw, count(lag_days) AS lag_count,
               CAST(sum(CASE WHEN is_risk THEN 1 ELSE 0 END) AS BIGINT) AS n,
               CAST(sum(CASE WHEN is_open THEN amt ELSE 0 END) AS BIGINT) AS outstanding,
               CAST(sum(CASE WHEN is_risk THEN amt ELSE 0 END) AS BIGINT) AS at_risk
        FROM (SELECT customer_name, CAST(greatest(0, date - invoice_date) AS DOUBLE) AS lag_days, false AS is_open,
                     false AS is_risk, 0 AS amt FROM audited
              UNION ALL
              SELECT customer_name, CASE WHEN is_overdue THEN CAST(late_days AS DOUBLE) END, true, is_risk,
                     expected_amount FROM open_orders) GROUP BY customer_name"""),
    "customer_reasons": (["open_orders"], """
        SELECT customer_name, string_agg(reason, ', ' ORDER BY rn) AS reasons FROM (
            SELECT customer_name, CASE WHEN is_overdue THEN 'Order ' || order_id || ' overdue by ' || late_days || ' days'
                   ELSE 'Order ' || order_id || ' flagged in discrepancy queue' END AS reason,
                   row_number() OVER (PARTITION BY customer_name ORDER BY ingest_seq, order_id) AS rn
            FROM open_orders WHERE is_risk) WHERE rn <= 2 GROUP BY customer_name"""),
    "scores": (["customer_base", "customer_reasons"], """
        SELECT customer_name, avg_lag_days, n AS default_violations_count, score AS reliability_score_percent,
               CASE WHEN n > 0 THEN 'REPEAT_DEFAULTER' WHEN score < 75 THEN 'CHRONIC_LAG'
                    WHEN score >= 90 THEN 'HIGH_RELIABILITY' ELSE 'MODERATE_DELAY' END AS reliability_badge,
               outstanding / 100.0 AS total_outstanding_inr, at_risk / 100.0 AS at_risk_amount_inr,
               CASE WHEN n > 0 THEN n || ' Default Violation(s) recorded (' || reasons || ')'
                    WHEN avg_lag_days > 5.0 THEN 'Chronic settlement lag ('
                         || CAST(CAST(avg_lag_days AS DECIMAL(10,1)) AS VARCHAR) || ' days late)'
                    ELSE 'All payments settled on-time' END AS default_reason_summary
        FROM (SELECT *, CAST(greatest(0, least(100, round_even(100 - avg_lag_days * 4 - n * 20, 0))) AS BIGINT) AS score
              FROM (SELECT b.*, r.reasons, CASE WHEN lag_count > 0 THEN round_even(avg_raw, 1)
                           ELSE CAST(2.0 AS DOUBLE) END AS avg_lag_days
                    FROM customer_base b LEFT JOIN customer_reasons r USING (customer_name)))"""),
    "inflow": (["open_orders", "scores"], f"""
        SELECT *, CASE WHEN is_overdue THEN 'Overdue Payment Violation' WHEN is_risk THEN 'Exception Flagged' END
                  AS risk_reason,
               CASE WHEN days_ahead <= 7 THEN '7D' WHEN days_ahead <= 14 THEN '14D' ELSE '30D' END AS bucket
        FROM (SELECT *, due_date - {AS_OF} AS days_ahead FROM (
            SELECT o.order_id, o.customer_name, o.expected_amount, o.currency = 'USD' AS is_usd,
                   CASE WHEN o.currency = 'USD' THEN CAST(round_even(o.expected_amount * CAST(83.5 AS DOUBLE), 0) AS BIGINT)
                        ELSE o.expected_amount END AS inr_paise,
                   o.due + CAST(round_even(coalesce(s.avg_lag_days, 2.0), 0) AS INTEGER) AS due_date,
                   o.is_overdue, o.is_risk
            FROM open_orders o LEFT JOIN scores s USING (customer_name)))"""),
    "forecast": (["inflow", "audited", "bank", "matches", "ledger"], """
        SELECT confirmed / 100.0 AS confirmed_bank_cash_inr, d7 / 100.0 AS projected_7d_inflow_inr,
               d14 / 100.0 AS projected_14d_inflow_inr, d30 / 100.0 AS projected_30d_inflow_inr,
               risk / 100.0 AS at_risk_receivables_30d_inr, usd / 100.0 AS fx_receivables_usd,
               usd_inr / 100.0 AS estimated_inr_value, w AS expected_collection_weight,
               CAST(0.25 AS DOUBLE) AS at_risk_recovery_weight,
               (confirmed + d30 + risk) / 100.0 AS best_case_30d_total_inr,
               (confirmed + careful) / 100.0 AS conservative_30d_total_inr,
               (d30 + risk - careful) / 100.0 AS uncertainty_margin_inr,
               healthy AS healthy_pending_orders, risky AS at_risk_pending_orders
        FROM (SELECT *, CAST(round_even(d30 * w + risk * CAST(0.25 AS DOUBLE), 0) AS BIGINT) AS careful FROM (
            SELECT CAST(coalesce(sum(inr_paise) FILTER (NOT is_risk AND days_ahead <= 7), 0) AS BIGINT) AS d7,
                   CAST(coalesce(sum(inr_paise) FILTER (NOT is_risk AND days_ahead <= 14), 0) AS BIGINT) AS d14,
                   CAST(coalesce(sum(inr_paise) FILTER (NOT is_risk AND days_ahead <= 30), 0) AS BIGINT) AS d30,
                   CAST(coalesce(sum(inr_paise) FILTER (is_risk), 0) AS BIGINT) AS risk,
                   CAST(coalesce(sum(expected_amount) FILTER (is_usd), 0) AS BIGINT) AS usd,
                   CAST(coalesce(sum(inr_paise) FILTER (is_usd), 0) AS BIGINT) AS usd_inr,
                   count(*) FILTER (NOT is_risk) AS healthy, count(*) FILTER (is_risk) AS risky
            FROM inflow), (
            SELECT CAST(CASE WHEN recent <> 0 THEN recent ELSE everything END AS BIGINT) AS confirmed FROM
              (SELECT sum(net_amount) AS recent FROM audited),
              (SELECT sum(net_amount) AS everything FROM bank)), (
            SELECT greatest(CAST(0.70 AS DOUBLE), least(CAST(0.95 AS DOUBLE), round_even(
                   (SELECT count(*) FROM matches) / greatest(1, (SELECT count(*) FROM ledger)), 3))) AS w))"""),
})


def with_ctes(body: str, *names: str) -> str:
    """``body`` with the named CTEs and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str):
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}"
