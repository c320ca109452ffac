"""Plain sequential models of the matchers, used as test oracles only."""

from __future__ import annotations

import datetime as dt
import re


def two_step(e):
    mdr = round(e * 0.02)
    return e - mdr - round(mdr * 0.18)


def one_step(e):
    return e - round(e * 0.0236)


def key_of(utr):
    return utr.strip().upper() if utr and utr.strip() else None


def settlement_key(row):
    if row["utr_reference"]:
        return key_of(row["utr_reference"])
    hit = re.search(r"\b(REF\d+)\b", row["description"] or "", re.I)
    return hit.group(1).upper() if hit else None


def visiting(bank):
    return sorted(bank, key=lambda r: (r["date"], r["settlement_id"]))


def ordering(ledger):
    return sorted(ledger, key=lambda r: (r["ingest_seq"], r["order_id"]))


def greedy(bank, ledger, label, used_s, used_o):
    out = []
    orders = ordering(ledger)
    for s in visiting(bank):
        if s["settlement_id"] in used_s:
            continue
        for o in orders:
            if o["order_id"] in used_o:
                continue
            name = label(s, o)
            if name:
                used_s.add(s["settlement_id"])
                used_o.add(o["order_id"])
                out.append((s["settlement_id"], o["order_id"], name))
                break
    return out


def _reference_pair(s, o, key):
    k = key(s)
    return k is not None and k == key_of(o["customer_reference"])


def exact_label(s, o, tol=500, days=3):
    if not _reference_pair(s, o, settlement_key):
        return None
    if abs((s["date"] - o["expected_settlement_date"]).days) > days:
        return None
    return "EXACT_REFERENCE_MATCH" if abs(s["net_amount"] - o["expected_amount"]) <= tol else None


def tolerance_label(s, o, tol=500, days=3):
    if not _reference_pair(s, o, settlement_key):
        return None
    if abs((s["date"] - o["expected_settlement_date"]).days) > days:
        return None
    net, e, fees = s["net_amount"], o["expected_amount"], s["fees_deducted"]
    if abs(net - two_step(e)) <= tol or (fees > 0 and abs(net - (e - fees)) <= tol):
        return "FEE_DEDUCTED_MATCH"
    return "ROUNDING_TOLERANCE_MATCH" if abs(net - e) <= tol else None


def lag_label(s, o, tol=500):
    if not _reference_pair(s, o, lambda r: key_of(r["utr_reference"])):
        return None
    net, e = s["net_amount"], o["expected_amount"]
    return "TIMING_LAG_MATCH" if abs(net - e) <= tol or abs(net - one_step(e)) <= tol else None


def triangulation_label(gateway, tol=500):
    def named(s, g):
        utr, sid, desc = s["utr_reference"], s["settlement_id"], s["description"] or ""
        return (
            (utr is not None and utr in (g["utr_reference"], g["payout_id"]))
            or sid == g["payout_id"]
            or (g["order_id"] and g["order_id"] in desc)
            or (g["payout_id"] and g["payout_id"] in desc)
            or sid.replace("STL", "PAY") == g["payout_id"]
            or sid.replace("STL", "PAYOUT") == g["payout_id"]
        )

    def label(s, o):
        e, net = o["expected_amount"], s["net_amount"]
        for g in gateway:
            if g["order_id"] != o["order_id"] or not named(s, g):
                continue
            targets = [g["net_payout"], two_step(e), e - round(e * 0.02), e]
            if any(abs(net - t) <= tol for t in targets):
                return "GATEWAY_3WAY_TRIANGULATION_MATCH"
        return None

    return label


def group_ref(text):
    text = (text or "").strip().upper()
    hit = re.search(r"REF\d+", text)
    return hit.group(0) if hit else text


def settlement_group(s):
    utr, desc = s["utr_reference"], s["description"]
    if desc and "REF" in desc.upper():
        return group_ref(desc)
    if utr and "REF" in utr.upper():
        return group_ref(utr)
    return group_ref(utr) or group_ref(desc)


def partial(bank, ledger, used_s, used_o, tol=500):
    by_ref = {}
    for o in ordering(ledger):
        if o["order_id"] not in used_o:
            by_ref[group_ref(o["customer_reference"]) or group_ref(o["order_id"])] = o
    groups = {}
    for s in visiting(bank):
        if s["settlement_id"] not in used_s and settlement_group(s):
            groups.setdefault(settlement_group(s), []).append(s)
    out = []
    for ref, rows in groups.items():
        o = by_ref.get(ref)
        if len(rows) < 2 or o is None:
            continue
        total, e = sum(r["net_amount"] for r in rows), o["expected_amount"]
        if abs(total - e) <= tol or abs(total - two_step(e)) <= tol:
            name = "PARTIAL_SETTLEMENT_MATCH"
        elif total > 0:
            name = "PARTIAL_SETTLEMENT_SHORTFALL"
        else:
            continue
        used_o.add(o["order_id"])
        for r in rows:
            used_s.add(r["settlement_id"])
            out.append((r["settlement_id"], o["order_id"], name))
    return out


def split(bank, ledger, used_s, used_o, tol=500):
    out = []
    for s in visiting(bank):
        if s["settlement_id"] in used_s:
            continue
        payer = key_of(s["payer_account"])
        free = [
            o for o in ordering(ledger)
            if payer and key_of(o["customer_name"]) == payer and o["order_id"] not in used_o
        ]
        if len(free) < 2:
            continue
        total = sum(o["expected_amount"] for o in free)
        if min(abs(s["net_amount"] - total), abs(s["net_amount"] - two_step(total))) <= tol:
            used_s.add(s["settlement_id"])
            for o in free:
                used_o.add(o["order_id"])
                out.append((s["settlement_id"], o["order_id"], "SPLIT_COMBINED_SETTLEMENT_MATCH"))
    return out


def all_phases(bank, ledger, gateway=None):
    used_s, used_o, out = set(), set(), []
    if gateway is not None:
        out += greedy(bank, ledger, triangulation_label(gateway), used_s, used_o)
    out += greedy(bank, ledger, exact_label, used_s, used_o)
    out += greedy(bank, ledger, tolerance_label, used_s, used_o)
    out += partial(bank, ledger, used_s, used_o)
    out += split(bank, ledger, used_s, used_o)
    out += greedy(bank, ledger, lag_label, used_s, used_o)
    return out


def random_batch(rng, n_s, n_o, n_ref, amounts=None, days=6, hot=0.0):
    """A small batch with many clashes: few references, amounts and days; ``hot``
    is the share of rows that carry one reference."""
    base = dt.date(2026, 7, 1)
    ref = lambda: "REF0" if rng.random() < hot else f"REF{rng.randrange(n_ref)}"
    pool = amounts or [100_000, 100_300, 100_600, 100_900, 60_000]
    ledger, bank, gateway = [], [], []
    for i in range(n_o):
        ledger.append(dict(
            order_id=f"ORD{i:04d}", invoice_date=base, expected_amount=rng.choice(pool),
            customer_name=f"Cust{rng.randrange(4)}", customer_reference=ref() if rng.random() < 0.9 else None,
            expected_settlement_date=base + dt.timedelta(days=rng.randrange(days)), tax_amount=0,
            currency="INR", status="unsettled", ingest_seq=rng.randrange(max(2, n_o))))
    for i in range(n_s):
        e = rng.choice(pool)
        net = rng.choice([e, e + 400, two_step(e), e // 2, one_step(e), e - 3_000, 2 * e, -5_000])
        utr = rng.choice([ref(), ref(), ref(), ref(), None, f"PAYOUT{rng.randrange(8):04d}"])
        desc = rng.choice(["Payout credit", f"Settlement for {ref()}", f"for ORD{rng.randrange(n_o):04d}"])
        bank.append(dict(
            settlement_id=f"STL{i:04d}", date=base + dt.timedelta(days=rng.randrange(days)), amount=net,
            utr_reference=utr, payer_account=f"Cust{rng.randrange(6)}",
            fees_deducted=rng.choice([0, 0, 3_000]), tax_deducted=0, net_amount=net, description=desc,
            currency="INR", ingest_seq=i))
    for i in range(n_o // 2):
        o = rng.choice(ledger)
        e = o["expected_amount"]
        gateway.append(dict(
            payout_id=f"PAYOUT{i:04d}", payout_date=base, order_id=o["order_id"], utr_reference=ref(),
            gross_amount=e, gateway_fee=0, gateway_tax=0, net_payout=rng.choice([two_step(e), e]),
            status="SETTLED", ingest_seq=i))
    return bank, ledger, gateway
