"""Packing: exact round trip of the ids, gapless places, and few sequences."""

import math
import random
import zlib

import numpy as np
import pytest

from tallyforge.llm import packing


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs:
        ids, parts = ids_of(text), sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [i for r in parts for i in r["ids"]] == ids
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert all(r["length"] == capacity for r in parts[1:]) and (len(ids) > capacity or len(parts) == 1)
        for r in parts:
            assert list(r["ids"]) == ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_round_trip(spark):
    rng = random.Random(2)
    odd = ["", None, " ", "\n\n", "a  b\tc\r\nd", "it's  we'll x", "<|endoftext|> <|endoftext|>", "a\x1cb \x1f c", "é " * 50, "x" * 5000,
           "　　y", "tail  ", "\n lead", "1 22 333 \n4"]
    docs = list(enumerate(odd + [" ".join(rng.choice(["alpha", "be.", "\nc", "D9"]) for _ in range(rng.randrange(1, 300))) for _ in range(80)]))
    df = spark.createDataFrame([(t, i, 5) for i, t in docs], "text string, doc_id long, length int")
    rows = packing.pack(df, capacity=64, keep_ids=True).collect()
    n, total = check(rows, docs, 64)
    assert n <= math.ceil(total / 64) + 3


def test_equal_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "same text")] * 50 + [(None, "same text")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 51
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    counts[1:] = rng.integers(0, [3, 50, 1000, 2][seed], 1024) * (rng.random(1024) < [1, .3, .05, 1][seed])
    counts[700] += 10**9 * (seed == 2)
    made = packing.plan(counts)
    used = np.zeros(1025, np.int64)
    for lengths, times in made:
        assert sum(lengths) <= 1024 and times > 0
        np.add.at(used, list(lengths), times)
    assert (used == counts).all() and len(made) < 20000
    if seed != 2:
        least = max(int((counts * np.arange(1025)).sum()) / 1024, int(counts[513:].sum()))  # two long pieces never share
        assert sum(t for _, t in made) <= least * 1.03 + 2


def test_plan_takes_exact_complements():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 2, 5, 1]] = [2, 2, 1, 2, 1, 5]
    made = packing.plan(counts, 10)
    assert sum(t for _, t in made) == 4 and all(sum(x) == 10 for x, _ in made)


def test_large_ids_beside_a_null(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b"), (None, "c"), (2**60 + 3, None)], "doc_id long, text string").repartition(1)
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {2**60 + 1, None, 2**60 + 3}
