"""Toxicity: held-out accuracy, and what the swap penalty is for."""

import random
import zlib

import numpy as np

from tallyforge.llm import toxicity


def made_up(rng, n):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moronic", "moronly", "scum"]))
        if rng.random() < (0.6 if toxic else 0.05):  # groups are named more often in toxic rows
            text.insert(rng.randrange(len(text)), rng.choice(["muslims", "women"]))
        rows.append((i, " ".join(text).capitalize(), int(toxic)))
    return rows


def test_learns_and_does_not_blame_groups(spark):
    rows = made_up(random.Random(4), 3000)
    docs = spark.createDataFrame([(t, i, 0.5) for i, t, _ in rows], "text string, doc_id long, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    truth = {i: y for i, _, y in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    unseen = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.99
    assert model.score("w1 w2 w3 muslims women w9") < 0.5 < 0.7 <= model.score("w1 w2 idiot w9")
    assert abs(model.weights.get("muslims", 0) - model.weights.get("christians", 0)) < 0.2


def test_penalty_closes_the_gap():
    rows = [[0, 2]] * 20 + [[2]] * 20 + [[0]] * 5 + [[1]] * 20
    y = np.array([1.0] * 40 + [0.0] * 25)
    free, _ = toxicity.fit(rows, y, [([0], [1])], 3, penalty=0.0)
    held, _ = toxicity.fit(rows, y, [([0], [1])], 3, penalty=10.0)
    assert abs(held[0] - held[1]) < 0.2 < abs(free[0] - free[1])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (4, "b " * 50000), (4, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1), (2, 1)], none.schema)):
        model = toxicity.train(docs, labels)
        got = toxicity.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
