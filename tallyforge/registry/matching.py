"""Registered queries: matching, shortlist, decisions and classification (M, G, J, F, X, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import adjudicate, assignment, matchers, shortlist
from tallyforge.plans import reconcile as rc
from tallyforge.plans import views
from tallyforge.registry.core import Registry
from tallyforge.registry.oracle_ctes import two_step, with_ctes
from tallyforge.sources import tables as t

PAIR = "SELECT settlement_id, order_id, rule_applied FROM {}"


PAIRED = """(SELECT settlement_id, nullif(upper(trim(utr_reference)), '') AS a, nullif(upper(trim(customer_reference)), '') AS b,
    trim(payer_account) AS c, trim(customer_name) AS d FROM bank JOIN ledger USING (ingest_seq)
    WHERE customer_reference IS NOT NULL AND utr_reference IS NOT NULL)"""


def _common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of up to 61 characters, one bit operation a character."""
    full = f"((CAST(1 AS BIGINT) << CAST(length({a}) AS INTEGER)) - 1)"
    places = (f"CAST(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch "
              f"THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS BIGINT)")
    steps = f"list_transform(string_split({b}, ''), lambda ch: {places})"
    row = f"list_reduce({steps}, lambda r, x: ((r + (r & x)) | (r - (r & x))) & {full}, {full})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({row}) END"


def _ratio(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) + length({b}) = 0 THEN CAST(1 AS DOUBLE) "
            f"ELSE CAST(2 * ({_common(a, b)}) AS DOUBLE) / (length({a}) + length({b})) END")


def _digits(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[^0-9]', '', 'g'), '^0+', '')"


def _windows_sql(rows: str) -> str:
    """Best ratio of the shorter of a and b with the windows of the longer: full ones, and shorter ones cut off at either end."""
    cut = lambda s, t: (
        f"list_concat(list_transform(range(1, length({t}) - length({s}) + 2), lambda i: substr({t}, i, length({s}))), list_concat("
        f"list_transform(range(1, length({s})), lambda i: substr({t}, 1, i)), "
        f"list_transform(range(1, length({s})), lambda i: substr({t}, length({t}) - i + 1, i))))")
    return f"""SELECT settlement_id, max({_ratio('s', 'w')}) AS best FROM (
        SELECT settlement_id, s, unnest({cut('s', 't')}) AS w FROM (
            SELECT settlement_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t
            FROM {rows} UNION ALL SELECT settlement_id, b, a FROM {rows} WHERE length(a) = length(b))) GROUP BY 1"""


def _bl(spark, d):
    return t.bank(spark, d), t.ledger(spark, d)


def register(reg: Registry):
    pairs = {
        "M1_gateway_triangulation": (
            lambda s, d: matchers.match_triangulation(t.bank(s, d), t.gateway(s, d), t.ledger(s, d)).select(
                "settlement_id", "order_id", "rule_applied"), "m1"),
        "M2_exact_reference": (lambda s, d: matchers.match_exact(*_bl(s, d)), "m2"),
        "M5_partial_groups": (lambda s, d: matchers.match_partial(*_bl(s, d)), "m5_alone"),
        "M7_split_combined": (lambda s, d: matchers.match_split(*_bl(s, d)), "m7_alone"),
        "M8_timing_lag": (lambda s, d: matchers.match_timing_lag(*_bl(s, d)), "m8_alone"),
    }
    for name, (fn, cte) in pairs.items():
        reg.add(name, fn, with_ctes(PAIR.format(cte), cte))

    reg.add(
        "M3_fee_deducted",
        lambda s, d: matchers.match_tolerance(*_bl(s, d)).filter("rule_applied = 'FEE_DEDUCTED_MATCH'"),
        with_ctes(PAIR.format("m3_alone") + " WHERE rule_applied = 'FEE_DEDUCTED_MATCH'", "m3_alone"))
    reg.add(
        "M4_rounding_tolerance",
        lambda s, d: matchers.match_tolerance(*_bl(s, d)).filter("rule_applied = 'ROUNDING_TOLERANCE_MATCH'"),
        with_ctes(PAIR.format("m3_alone") + " WHERE rule_applied = 'ROUNDING_TOLERANCE_MATCH'", "m3_alone"))
    reg.add(
        "M2_M4_fused_reference_phases",
        lambda s, d: matchers.match_exact_then_tolerance(*_bl(s, d)), with_ctes(PAIR.format("found3"), "found3"))

    def shortfall(s, d):
        return matchers.partial_groups(*_bl(s, d)).filter(
            "rule_applied = 'PARTIAL_SETTLEMENT_SHORTFALL'"
        ).select("order_id", "n", "total", "fee_net", "variance_paise")

    reg.add("M6_partial_shortfall", shortfall, with_ctes(f"""
        SELECT p.order_id, count(*) AS n, CAST(sum(b.net_amount) AS BIGINT) AS total,
               {two_step('any_value(l.expected_amount)')} AS fee_net,
               {two_step('any_value(l.expected_amount)')} - CAST(sum(b.net_amount) AS BIGINT) AS variance_paise
        FROM m5_alone p JOIN bank b USING (settlement_id) JOIN ledger l USING (order_id)
        WHERE p.rule_applied = 'PARTIAL_SETTLEMENT_SHORTFALL' GROUP BY p.order_id""", "m5_alone", "ledger"))

    from tallyforge.registry.oracle_ctes import GROUP_REF

    reg.add(
        "M6k_group_reference_choice",
        lambda s, d: t.bank(s, d).select(
            "settlement_id",
            text.settlement_group_reference(F.col("utr_reference"), F.col("description")).alias("ref")),
        with_ctes(f"SELECT settlement_id, {GROUP_REF} AS ref FROM bank", "bank"))

    def greedy(s, d):
        b, l = _bl(s, d)
        pair = matchers._settlement_side(b, matchers.reference_key_of(b)).join(matchers._order_side(l), "key")
        edges = pair.filter(F.abs(F.col("net_amount") - F.col("expected_amount")) <= 60_000).select(
            "key", F.lit(1).alias("phase"), "s_pos", "o_pos", F.lit("near").alias("label"))
        return assignment.fold_by_key(edges).select(
            F.col("s_pos.settlement_id").alias("settlement_id"), F.col("o_pos.order_id").alias("order_id"))

    reg.add("G1_greedy_assignment", greedy, with_ctes("""
        SELECT settlement_id, order_id FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY date, settlement_id) AS rn
            FROM pairs WHERE abs(net_amount - expected_amount) <= 60000) WHERE rn = 1""", "pairs"))

    reg.add(
        "reconcile_batch",
        lambda s, d: views.matches(s, d).select(
            "settlement_id", "order_id", "rule_applied", "confidence", "phase"),
        with_ctes("SELECT settlement_id, order_id, rule_applied, confidence, phase FROM matches", "matches"))
    reg.add(
        "reconcile_rule_counts",
        lambda s, d: rc.match_phases(*_bl(s, d)).groupBy("rule_applied", "phase").agg(F.count("*").alias("n")),
        with_ctes("SELECT rule_applied, phase, count(*) AS n FROM matches GROUP BY ALL", "matches"))

    reg.add(
        "J1_unmatched_settlements",
        lambda s, d: matchers.unmatched(t.bank(s, d), views.matches(s, d), "settlement_id").select(
            "settlement_id", "date", "net_amount", "utr_reference"),
        with_ctes(
            "SELECT settlement_id, CAST(date AS VARCHAR) AS date, net_amount, utr_reference FROM free_bank",
            "free_bank"))
    reg.add(
        "J1_unmatched_orders",
        lambda s, d: matchers.unmatched(t.ledger(s, d), views.matches(s, d), "order_id").select(
            "order_id", "expected_amount", "customer_reference"),
        with_ctes("SELECT order_id, expected_amount, customer_reference FROM free_ledger", "free_ledger"))
    reg.add(
        "J2_settled_references",
        lambda s, d: matchers.settled_references(t.bank(s, d), views.matches(s, d)),
        with_ctes("SELECT utr_reference FROM settled", "settled"))
    reg.add(
        "U2_set_membership",
        lambda s, d: t.bank(s, d).join(views.matches(s, d), "settlement_id", "left_anti").join(
            views.exceptions(s, d).select(F.col("record_id").alias("settlement_id")), "settlement_id", "left_semi"
        ).select("settlement_id"),
        with_ctes(
            "SELECT settlement_id FROM free_bank WHERE settlement_id IN (SELECT record_id FROM exceptions)",
            "exceptions"))
    reg.add(
        "W1_visiting_order",
        lambda s, d: matchers.visiting_order(t.bank(s, d)).filter("key is not null").select(
            "settlement_id", "key", "visit"),
        with_ctes("""SELECT settlement_id, key,
            row_number() OVER (PARTITION BY key ORDER BY date, settlement_id) AS visit
            FROM bank_key WHERE key IS NOT NULL""", "bank_key"))

    # Classification.
    reg.add("X_exceptions", lambda s, d: views.exceptions(s, d), with_ctes(
        "SELECT record_id, source, category, reason, suggested_action, priority, is_exception FROM exceptions",
        "exceptions"))
    for name, category in {
        "X1_chargeback": "CHARGEBACK_REVERSAL", "X2_duplicate": "DUPLICATE_SETTLEMENT",
        "X3_pending_settlement": "PENDING_SETTLEMENT", "X5a_orphan_settlement": "ORPHAN_BANK_SETTLEMENT",
        "X5b_orphan_order": "ORPHAN_LEDGER_ORDER",
    }.items():
        reg.add(
            name,
            lambda s, d, category=category: views.exceptions(s, d).filter(F.col("category") == category).select(
                "record_id", "reason", "suggested_action", "priority"),
            with_ctes(
                "SELECT record_id, reason, suggested_action, priority FROM exceptions"
                f" WHERE category = '{category}'", "exceptions"))
    for name, category in {
        "X4a_fee_overcharge": "PLATFORM_FEE_OVERCHARGE", "X4b_missing_tds": "MISSING_TDS_WITHHOLDING",
        "X4c_missing_bank_credit": "MISSING_BANK_CREDIT", "X4d_ambiguous": "UNRESOLVED_AMBIGUOUS_DISCREPANCY",
    }.items():
        reg.add(name, lambda s, d, category=category: _candidate_class(s, d, category), _candidate_sql(category))

    def waiting(s, d):
        """Every seventh bank row found no adjudicator free."""
        from tallyforge.operators import classify

        free, top = _candidate_batch(s, d)
        pending = free.filter(F.col("ingest_seq") % 7 == 0).select(
            "settlement_id", F.concat(F.lit("No capacity for "), "settlement_id").alias("pending_reason"))
        nothing = free.select("utr_reference").filter(F.lit(False))
        return classify.classify_bank(free, nothing, top, pending).filter("category = 'PENDING_VERIFICATION'").select(
            "record_id", "reason", "suggested_action", "priority", "is_exception")

    reg.add("X0_pending_verification", waiting, with_ctes("""
        SELECT settlement_id AS record_id, 'No capacity for ' || settlement_id AS reason,
               'Awaiting AI verification capacity. Will resolve automatically on next run.' AS suggested_action,
               'LOW' AS priority, false AS is_exception FROM bank WHERE ingest_seq % 7 = 0""", "bank"))

    # Shortlist and decisions.
    def pairs_of(s, d):
        return t.bank(s, d).select("settlement_id", "ingest_seq", "utr_reference", "payer_account").join(
            t.ledger(s, d), "ingest_seq").filter("customer_reference is not null and utr_reference is not null")

    from tallyforge.functions import similarity

    up = lambda c: text.reference_key(F.col(c))
    reg.add("F1_indel_ratio", lambda s, d: pairs_of(s, d).select(
        "settlement_id", F.round(similarity.indel_ratio(up("utr_reference"), up("customer_reference")), 4).alias("score")),
        with_ctes(f"SELECT settlement_id, round({_ratio('a', 'b')}, 4) AS score FROM {PAIRED}", "bank", "ledger"))
    reg.add("F2_partial_ratio", lambda s, d: pairs_of(s, d).select(
        "settlement_id", F.round(similarity.partial_ratio(up("utr_reference"), up("customer_reference")), 4).alias("score")),
        with_ctes(f"""SELECT settlement_id, round(best, 4) AS score FROM {PAIRED} LEFT JOIN ({_windows_sql(PAIRED)}) USING (settlement_id)""",
                  "bank", "ledger"))
    reg.add("F3_digit_ratio", lambda s, d: pairs_of(s, d).select(
        "settlement_id", F.round(similarity.indel_ratio(
            text.digit_key(up("utr_reference")), text.digit_key(up("customer_reference"))), 4).alias("score")),
        with_ctes(f"""SELECT settlement_id, round({_ratio('p', 'q')}, 4) AS score
            FROM (SELECT settlement_id, {_digits('a')} AS p, {_digits('b')} AS q FROM {PAIRED})""", "bank", "ledger"))
    reg.add("F4_reference_score", lambda s, d: pairs_of(s, d).select(
        "settlement_id",
        F.round(shortlist.reference_score(up("utr_reference"), up("customer_reference")), 4).alias("score")),
        with_ctes(f"""SELECT settlement_id, round(greatest({_ratio('a', 'b')}, best, CASE WHEN p <> '' AND q <> '' THEN {_ratio('p', 'q')} END), 4) AS score
            FROM (SELECT settlement_id, a, b, {_digits('a')} AS p, {_digits('b')} AS q FROM {PAIRED})
            LEFT JOIN ({_windows_sql(PAIRED)}) USING (settlement_id)""", "bank", "ledger"))
    reg.add("F5_token_sort_ratio", lambda s, d: pairs_of(s, d).select(
        "settlement_id",
        F.round(shortlist.name_score(F.col("payer_account"), F.col("customer_name")), 4).alias("score")),
        with_ctes(f"""SELECT settlement_id, CASE WHEN coalesce(p, '') <> '' AND coalesce(q, '') <> '' THEN round({_ratio('p', 'q')}, 4) ELSE 0 END AS score
            FROM (SELECT settlement_id, array_to_string(list_sort(regexp_split_to_array(c, '\\s+')), ' ') AS p,
                         array_to_string(list_sort(regexp_split_to_array(d, '\\s+')), ' ') AS q FROM {PAIRED})""", "bank", "ledger"))

    def neighbours(s, d):
        e = t.table(s, d, "embeddings")
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        return e.join(nxt, "vec_id").select(
            "vec_id", F.round(shortlist.semantic_score(F.col("embedding"), F.col("other")), 4).alias("score"))

    reg.add("F6_semantic_score", neighbours, """
        SELECT a.vec_id, round(greatest(0, least(1, list_dot_product(
                   CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS score
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
    reg.add(
        "F7_comparison_text",
        lambda s, d: t.bank(s, d).select(
            "settlement_id",
            text.comparison_text(F.col("payer_account"), F.col("description"), F.col("utr_reference")).alias("text")),
        with_ctes("""SELECT settlement_id, trim(payer_account || ' ' || description || ' '
                  || coalesce(utr_reference, '')) AS text FROM bank""", "bank"))

    def hybrid(s, d):
        c = F.col("value") / 500
        return t.table(s, d, "events").select(
            "event_id", shortlist.hybrid_score(c, 1 - c, F.lit(0.5)).alias("score"))

    reg.add("F8_hybrid_score", hybrid, """
        SELECT event_id, CASE WHEN c >= 0.75 THEN greatest(c, CAST(0.7 AS DOUBLE) * c
                   + CAST(0.3 AS DOUBLE) * CAST(0.5 AS DOUBLE))
               ELSE CAST(0.4 AS DOUBLE) * c + CAST(0.3 AS DOUBLE) * (1 - c)
                   + CAST(0.3 AS DOUBLE) * CAST(0.5 AS DOUBLE) END AS score
        FROM (SELECT event_id, value / 500 AS c FROM events)""")
    reg.add("F9_shortlist", lambda s, d: views.adjudicated(s, d).candidates.select(
        "settlement_id", "order_id", "similarity_score", "rank"))
    reg.add("F10_deterministic_precheck", lambda s, d: adjudicate.precheck(views.adjudicated(s, d).candidates))
    reg.add("F11_local_scorer", lambda s, d: adjudicate.local_score(views.adjudicated(s, d).candidates))
    reg.add("F12_confidence_router", lambda s, d: views.adjudicated(s, d).outcomes.select(
        "settlement_id", "outcome", "rule_applied", "matched_order_id", "confidence"))
    reg.add("F13_decision_key", lambda s, d: adjudicate.decision_key(views.adjudicated(s, d).candidates))

    def decisions(s, d):
        k = F.col("ingest_seq")
        raw = t.bank(s, d).select(
            F.col("settlement_id").alias("decision_key"),
            F.when(k % 11 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(
                F.when(k % 5 == 0, "maybe").otherwise("match").alias("decision"),
                F.lit("ORD1").alias("matched_order_id"), ((k % 130) / 100).alias("confidence"),
                F.lit("because").alias("reasoning"), F.lit("EXTERNAL").alias("rule_category")))).alias("payload"))
        ok, bad = adjudicate.parse_decisions(raw)
        return ok.select("decision_key", "confidence", F.lit(True).alias("valid")).unionByName(
            bad.select("decision_key", F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("valid")))

    reg.add("F14_decision_validation", decisions, with_ctes("""
        SELECT settlement_id AS decision_key, CASE WHEN ok THEN c END AS confidence, ok AS valid FROM (
            SELECT settlement_id, c, ingest_seq % 11 <> 0 AND ingest_seq % 5 <> 0 AND c <= 1.0 AS ok FROM (
                SELECT settlement_id, ingest_seq, (ingest_seq % 130) / 100 AS c FROM bank))""", "bank"))
    reg.add("X4e_ledger_candidates", lambda s, d: rc.classify_unmatched(
        views.adjudicated(s, d), t.bank(s, d), views.AS_OF))
    def triangulation_reasons(s, d):
        b, l = _bl(s, d)
        found = rc._tagged(matchers.match_triangulation(b, t.gateway(s, d), l))
        return rc.with_reasons(found, b, l).select("settlement_id", "order_id", "reason")

    from tallyforge.registry.oracle_ctes import mdr, rupees

    reg.add("N17_triangulation_reasons", triangulation_reasons, with_ctes(f"""
        SELECT settlement_id, order_id, '3-Way Triangulation Verified: Bank Settlement ' || settlement_id || ' (Net '
               || {rupees('net_amount')} || ') <--> Gateway Payout PAYOUT' || order_id[4:] || ' <--> ERP Order ' || order_id
               || ' (Gross ' || {rupees('expected_amount')} || ', MDR 2% ' || {rupees(mdr('expected_amount'))} || ')' AS reason
        FROM m1 JOIN bank USING (settlement_id) JOIN ledger USING (order_id)""", "m1"))
    reg.add("N17_audit_reasons", lambda s, d: rc.with_reasons(
        views.matches(s, d), t.bank(s, d), t.ledger(s, d)).select(
        "settlement_id", "order_id", "rule_applied", "reason"), _reasons_sql())


def _candidate_batch(s, d):
    """Every bank row with the order of its own number as candidate, with fees, taxes
    and references that reach each rule."""
    k = F.col("ingest_seq")
    free = t.bank(s, d).withColumns({
        "fees_deducted": F.when(k % 3 == 0, F.col("amount")).otherwise(F.col("fees_deducted")),
        "tax_deducted": F.when(k % 4 == 0, F.lit(25_000)).otherwise(F.lit(0)).cast("long"),
        "utr_reference": F.when(k % 5 == 0, F.concat(F.lit("ORPHAN"), k.cast("string"))).otherwise(
            F.col("utr_reference")),
    })
    top = t.bank(s, d).filter("settlement_id not like 'STC%'").select("settlement_id", "ingest_seq").join(
        t.ledger(s, d).select("ingest_seq", "order_id", "expected_amount"), "ingest_seq")
    return free, top


def _candidate_class(s, d, category):
    from tallyforge.operators import classify

    free, top = _candidate_batch(s, d)
    nothing = free.select("utr_reference").filter(F.lit(False))
    return classify.classify_bank(free, nothing, top).filter(F.col("category") == category).select(
        "record_id", "reason", "suggested_action", "priority")


def _candidate_sql(category):
    from tallyforge.registry.oracle_ctes import mdr, rupees

    r = rupees
    reason = {
        "PLATFORM_FEE_OVERCHARGE": f"""'Platform fee overcharge detected on settlement ' || settlement_id || ' (Order: '
            || order_id || '). Deducted fee ' || {r('fee')} || ' exceeds 2.0% contract rate ' || {r('contract')} || '.'""",
        "MISSING_TDS_WITHHOLDING": f"""'Sec 194O TDS withholding mismatch on settlement ' || settlement_id || ' (Order: '
            || order_id || '). Bank tax withheld ' || {r('tds')} || ' vs expected ' || {r('contract')} || '.'""",
        "MISSING_BANK_CREDIT": f"""'Bank settlement ' || settlement_id || ' on ' || date || ' (' || {r('net_amount')}
            || ') has unmapped UTR reference ''' || utr || '''.'""",
        "UNRESOLVED_AMBIGUOUS_DISCREPANCY": f"""'Bank settlement ' || settlement_id || ' on ' || date || ' (net '
            || {r('net_amount')} || ', UTR: ''' || coalesce(utr, 'N/A') || ''') reference matches candidate order '
            || order_id || ' (expected ' || {r('e')} || '), but amount differs by '
            || {r('abs(net_amount - (e - contract))')} || ' (expected net after 2% fee ' || {r('(e - contract)')} || ').'""",
    }[category]
    action = {
        "PLATFORM_FEE_OVERCHARGE": f"""'File fee overcharge dispute with payment gateway to recover '
            || {r('(fee - contract)')} || '.'""",
        "MISSING_TDS_WITHHOLDING":
            "'Issue revised TDS certificate / tax adjustment note to gateway for order ' || order_id || '.'",
        "MISSING_BANK_CREDIT":
            "'Contact gateway team to map orphan settlement ' || settlement_id || ' to internal ERP order.'",
        "UNRESOLVED_AMBIGUOUS_DISCREPANCY":
            "'Review fee agreement or check for unrecorded partial refund/adjustment on order ' || order_id || '.'",
    }[category]
    priority = "MEDIUM" if category.startswith("UNRESOLVED") else "HIGH"
    return with_ctes(f"""
        SELECT settlement_id AS record_id, {reason} AS reason, {action} AS suggested_action,
               '{priority}' AS priority
        FROM (SELECT *, CASE WHEN fee > contract + 500 THEN 'PLATFORM_FEE_OVERCHARGE'
                     WHEN tds > 0 THEN 'MISSING_TDS_WITHHOLDING'
                     WHEN contains(utr, 'ORPHAN') OR contains(utr, 'MISSING') THEN 'MISSING_BANK_CREDIT'
                     ELSE 'UNRESOLVED_AMBIGUOUS_DISCREPANCY' END AS category
              FROM (SELECT b.settlement_id, b.date, b.net_amount, l.order_id, l.expected_amount AS e,
                           CASE WHEN b.ingest_seq % 3 = 0 THEN b.amount ELSE b.fees_deducted END AS fee,
                           CASE WHEN b.ingest_seq % 4 = 0 THEN 25000 ELSE 0 END AS tds,
                           CASE WHEN b.ingest_seq % 5 = 0 THEN 'ORPHAN' || b.ingest_seq ELSE b.utr_reference END AS utr,
                           {mdr('l.expected_amount')} AS contract
                    FROM bank b JOIN ledger l ON b.ingest_seq = l.ingest_seq
                    WHERE b.settlement_id NOT LIKE 'STC%' AND b.net_amount >= 0))
        WHERE category = '{category}'""", "bank", "ledger")


def _reasons_sql():
    from tallyforge.registry.oracle_ctes import gst, mdr, rupees

    e, r = "expected_amount", rupees
    net2 = two_step(e)
    used = r"coalesce(nullif(utr_reference, ''), nullif(regexp_extract(description, '(?i)\b(REF\d+)\b', 1), ''))"
    return with_ctes(f"""
        SELECT settlement_id, order_id, rule_applied, CASE rule_applied
          WHEN 'EXACT_REFERENCE_MATCH' THEN 'Exact Reference Verified: Settlement ' || settlement_id || ' (Ref: '''
             || {used} || ''') matched Order ' || order_id || ' (Ref: ''' || upper(trim({used})) || ''') within '
             || abs(net_amount - {e}) || ' paise variance.'
          WHEN 'FEE_DEDUCTED_MATCH' THEN 'Fee Deduction Verified: Gross ' || {r(e)} || ' - MDR Fee 2% '
             || {r(mdr(e))} || ' - GST 18% ' || {r(gst(e))} || ' = Expected Net ' || {r(net2)} || ' (Bank Net '
             || {r('net_amount')} || ', Variance ' || abs(net_amount - {net2}) || ' paise)'
          WHEN 'PARTIAL_SETTLEMENT_MATCH' THEN 'Partial Payment Group Verified: Reference ''' || ref
             || ''' matched Order ' || order_id || ' (Total Bank Net ' || {r('total')} || ' vs Expected Net '
             || {r(net2)} || ')'
          WHEN 'PARTIAL_SETTLEMENT_SHORTFALL' THEN 'Partial settlement group underpaid by '
             || {r(f'({net2} - total)')} || ' (total bank net ' || {r('total')} || ' vs expected net ' || {r(net2)} || ')'
          WHEN 'SPLIT_COMBINED_SETTLEMENT_MATCH' THEN 'Split Batch Settlement Verified: Settlement '
             || settlement_id || ' (Net ' || {r('net_amount')} || ') matched batch orders for Payer '''
             || upper(trim(payer_account)) || ''' (Total Gross ' || {r('gross')} || ', Expected Net '
             || {r(two_step('gross'))} || ')' END AS reason
        FROM (SELECT *, CAST(sum(net_amount) OVER (PARTITION BY order_id) AS BIGINT) AS total,
                     CAST(sum({e}) OVER (PARTITION BY settlement_id) AS BIGINT) AS gross,
                     {_group_ref()} AS ref FROM audited)""", "audited")


def _group_ref():
    from tallyforge.registry.oracle_ctes import GROUP_REF

    return GROUP_REF
