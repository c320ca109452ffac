"""The distributed matchers against the sequential models, on random clashing batches."""

import random

import pytest

from tallyforge import schemas
from tallyforge.operators import matchers
from tallyforge.settings import Settings
from tests import sequential as seq


def frames(spark, bank, ledger, gateway=None):
    out = [spark.createDataFrame(bank, schemas.BANK), spark.createDataFrame(ledger, schemas.LEDGER)]
    if gateway is not None:
        out.append(spark.createDataFrame(gateway, schemas.GATEWAY))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("settlement_id", "order_id", "rule_applied").collect())


def blocks(rng, count, **kw):
    """Many independent batches in one frame: ids and references carry a batch number."""
    bank, ledger, expected = [], [], []
    for n in range(count):
        b, l, _ = seq.random_batch(rng, rng.randrange(2, 12), rng.randrange(2, 12), rng.randrange(1, 4), **kw)
        for r in b:
            r["settlement_id"] = f"B{n}-{r['settlement_id']}"
            if r["utr_reference"]:
                r["utr_reference"] = f"B{n}{r['utr_reference']}"
            r["description"] = "none"
        for r in l:
            r["order_id"] = f"B{n}-{r['order_id']}"
            if r["customer_reference"]:
                r["customer_reference"] = f"B{n}{r['customer_reference']}"
        bank += b
        ledger += l
        expected.append((b, l))
    return bank, ledger, expected


PHASES = {
    "exact": (matchers.match_exact, [seq.exact_label]),
    "tolerance": (matchers.match_tolerance, [seq.tolerance_label]),
    "both": (matchers.match_exact_then_tolerance, [seq.exact_label, seq.tolerance_label]),
    "lag": (matchers.match_timing_lag, [seq.lag_label]),
}


@pytest.mark.parametrize("phase", PHASES)
def test_two_hundred_small_batches(spark, phase):
    run, labels = PHASES[phase]
    bank, ledger, parts = blocks(random.Random(11), 200)
    want = []
    for b, l in parts:
        used_s, used_o = set(), set()
        for label in labels:
            want += seq.greedy(b, l, label, used_s, used_o)
    assert len(want) > 100
    assert got(run(*frames(spark, bank, ledger))) == sorted(want)


@pytest.mark.parametrize("phase", ["both", "lag"])
@pytest.mark.parametrize("seed", [1, 2])
def test_hot_reference_in_rounds(spark, phase, seed):
    """A third of all rows share one reference; every key goes through the rounds."""
    run, labels = PHASES[phase]
    rng = random.Random(seed)
    bank, ledger, _ = seq.random_batch(rng, 60, 60, 40, hot=0.4, days=4)
    want, used_s, used_o = [], set(), set()
    for label in labels:
        want += seq.greedy(bank, ledger, label, used_s, used_o)
    assert got(run(*frames(spark, bank, ledger), Settings(hot_key_pairs=3, max_window_rows=5))) == sorted(want)


def test_hot_reference_with_one_amount_needs_no_pairs(spark):
    """One key, one amount, one day: 3000 x 3000 alike rows are zipped, not paired."""
    rng = random.Random(5)
    bank, ledger, _ = seq.random_batch(rng, 3000, 3000, 1, amounts=[100_000], days=1)
    for r in bank:
        r.update(net_amount=100_000, utr_reference="REF0", description="x", fees_deducted=0)
    for r in ledger:
        r.update(customer_reference="REF0")
    want = seq.greedy(bank, ledger, seq.exact_label, set(), set())
    assert got(matchers.match_exact(*frames(spark, bank, ledger))) == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_triangulation(spark, seed):
    bank, ledger, gateway = seq.random_batch(random.Random(seed), 30, 24, 8, hot=0.3)
    want = seq.greedy(bank, ledger, seq.triangulation_label(gateway), set(), set())
    b, l, g = frames(spark, bank, ledger, gateway)
    assert len(want) > 3
    assert got(matchers.match_triangulation(b, g, l)) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_groups_and_splits(spark, seed):
    bank, ledger, _ = seq.random_batch(random.Random(seed), 40, 20, 6, amounts=[40_000, 20_000])
    b, l = frames(spark, bank, ledger)
    assert got(matchers.match_partial(b, l)) == sorted(seq.partial(bank, ledger, set(), set()))
    assert got(matchers.match_split(b, l)) == sorted(seq.split(bank, ledger, set(), set()))
