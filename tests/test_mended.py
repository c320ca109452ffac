"""Cases of the last review: ambiguous row hashes, salted joins, chunks, recall of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import quality, skewjoin
from tallyforge.plans import analytics, preparation


def test_row_hash_tells_rows_apart(spark):
    df = spark.createDataFrame([("a|vb", "c"), ("a", "b|vc"), (None, "n"), ("n", None), ("", None)], "x string, y string")
    assert df.select(quality.row_hash(["x", "y"])).distinct().count() == 5


def test_salted_join_refuses_outer_sides(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            skewjoin.salted_join(df, df, "k", 10, how=how)


def test_fixed_chunks(spark):
    rng = random.Random(1)
    texts = ["", " ", "short", "x" * 1200] + [" ".join("w" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 300))) for _ in range(20)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", preparation.fixed_chunks(F.col("t")).alias("c")).collect()
    for r in got:
        text, at = r["t"], 0
        for piece in r["c"]:
            part = text[at:at + 500]
            last = part.rfind(" ") if at + 500 < len(text) else -1
            length = last if last > 400 else 500
            assert piece == part[:length].strip()
            at += length - 50
        assert at >= len(text)


def test_blank_due_dates_are_not_overdue(spark):
    ledger = spark.createDataFrame(
        [("a", "2026-01-01", None, 100, "x"), ("b", "2026-01-01", "2026-01-05", 100, "x")],
        "order_id string, invoice_date string, expected_settlement_date string, expected_amount long, customer_name string",
    ).withColumns({c: F.col(c).cast("date") for c in ("invoice_date", "expected_settlement_date")})
    matches = spark.createDataFrame([], "order_id string")
    flagged = spark.createDataFrame([], "record_id string")
    late = lambda df: {r["order_id"]: r["is_overdue"] for r in analytics.open_orders(matches, df, flagged, "2026-02-01").collect()}
    assert late(ledger) == {"a": False, "b": True}
    assert late(ledger.drop("expected_settlement_date")) == {"a": True, "b": True}
