"""Sharding: the law of bytes, gapless places, and maps that change little."""

import random
import zlib

from tallyforge.llm import sharding


def test_places_and_bytes(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(0, 400)) for i in range(3000)] + [(5000, None), (None, "a"), (None, "b"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(t, i, 3) for i, t in rows], "text string, doc_id long, size int")
    got = sharding.assign(df).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load = {}
    for r in got:
        load.setdefault(r["shard"], []).append(r)
    assert set(load) == set(range(16))
    for part in load.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sums = [sum(r["size"] for r in part) for part in load.values()]
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 16
    assert sharding.assign(df.limit(0)).count() == 0


def test_rebalance_moves_little(spark, tmp_path):
    rng = random.Random(2)
    weight = {v: rng.randrange(50, 150) for v in range(8192)}
    one = sharding.first_map(weight)
    assert sharding.rebalanced(one, weight, 16) == one
    grown = sharding.rebalanced(one, weight, 17)
    moved = [v for v in range(8192) if grown[v] != one[v]]
    assert all(grown[v] == 16 for v in moved) and len(moved) < 8192 / 17 * 1.1
    load = [sum(w for v, w in weight.items() if grown[v] == s) for s in range(17)]
    assert max(load) <= sum(load) / 17 * 1.006
    shrunk = sharding.rebalanced(grown, weight, 16)
    assert max(shrunk) == 15 and all(shrunk[v] == grown[v] for v in range(8192) if grown[v] < 16)
    for version, shard_of in enumerate((one, grown)):
        sharding.save_map(spark, str(tmp_path), version, shard_of)
    assert sharding.load_map(spark, str(tmp_path), 0) == one and sharding.load_map(spark, str(tmp_path), 1) == grown
