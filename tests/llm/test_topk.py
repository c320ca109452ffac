"""Exact top-k against every product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import topk


def model(rows, ask, k=10):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if ask(q):
            best = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b))), i) for i, b in ok if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_equals_all_products(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 8))
    rows = [(i, (scale * (centre[i % 6] * (1 + i % 3) + 0.2 * rng.normal(size=8))).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[10][1]) for i in range(120)] + [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8),
                                                             (2300, [float("inf")] * 8), (2400, [0.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(v, i, 1) for i, v in rows], "embedding array<double>, vec_id long, rank int")
    got = topk.search(df, df.filter("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == model(rows, lambda i: i % 100 == 0)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [3.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == model([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (100, [3.0, -1.0])], lambda i: i % 100 == 0)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0
    assert topk.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


def test_query_blocks_of_one_hash_all_search(spark):
    """Two query blocks whose hashes agree in 20 bits meet the same annulus: both get their candidates."""
    numbers = spark.range(20000).groupBy(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h")).agg(F.sort_array(F.collect_list("id")).alias("b"))
    one, other = numbers.filter("size(b) > 1").orderBy("h").first()["b"][:2]
    pack = lambda ids, v: [bytearray(np.array(ids, np.int64).tobytes()), bytearray(np.array(v, float).tobytes())]
    index = spark.createDataFrame([[7] + pack([1, 2], [[1, 0], [0, 1]])], "block long, ids binary, vectors binary")
    queries = spark.createDataFrame([[one] + pack([10], [[3, 1]]) + [None], [other] + pack([20], [[1, 5]]) + [None]],
                                    "q_block long, q_ids binary, q_vectors binary, floors binary")
    pairs = queries.select("q_block").withColumn("block", F.lit(7).cast("long"))
    found = topk._search(pairs, index, queries, 2, 10, True)
    assert sorted(map(tuple, found.select("query_id", "vec_id", "score").collect())) == [(10, 1, 3), (10, 2, 1), (20, 1, 1), (20, 2, 5)]


def test_repeated_query_rows(spark):
    """Equal query rows are one query, two vectors of one id two; candidate rows count each."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(2**60 + 1, rng.normal(size=4).tolist())]
    rows += [rows[0], rows[7], (0, [9.0, 1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.search(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == sorted(model([rows[0]] + rows[1:41] + [rows[42]], lambda i: i == 0) + [
        r for r in model([rows[43]] + rows[1:41] + [rows[42]], lambda i: i == 0)])


def test_beyond_doubles(spark):
    """Scores beyond 2^53 that differ by one keep their order."""
    big = float(2**20)
    rows = [(0, [big, 1 / 1024])] + [(i, [big, i / 1024]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == model(rows, lambda i: i == 0) and len({s for *_, s in got}) == 10
