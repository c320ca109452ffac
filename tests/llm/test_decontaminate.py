"""Benchmark passages against brute force over every document and item."""

import random

from tallyforge.llm import decontaminate as dc


def levenshtein_inside(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def vocabulary(rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        assert dc.edit_distance_inside(a, b) == levenshtein_inside(a, b)


def test_recall_of_edited_passages_and_clean_documents(spark):
    rng = random.Random(5)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randrange(12, 60))) for k in range(60)]
    docs, want = [], set()
    for i in range(300):
        body = text(rng.randrange(0, 200)).split()
        if i % 2:
            k, passage = items[i % 60][0], items[i % 60][1].split()
            for _ in range(len(passage) // 10):
                at = rng.randrange(len(passage))
                passage[at:at + 1] = rng.choice([[], [rng.choice(words)], [passage[at], "new"]])
            if levenshtein_inside(items[k][1], " ".join(passage)) <= 0.2 * len(items[k][1]):
                want.add((i, k))
            body[len(body) // 2:len(body) // 2] = passage
        docs.append((i, "  ".join(body).upper() + ".", "x"))
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    found = dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert not got - want and len(got) >= 0.98 * len(want)


def test_exact_passages_of_any_size(spark):
    rng = random.Random(9)
    words = vocabulary(rng)
    items = [(n, " ".join(rng.choice(words) for _ in range(n))) for n in (1, 2, 3, 5, 8, 9, 17, 33, 70, 150, 400)]
    docs = [(n, "start, " + t + "; end") for n, t in items if n > 3] + [(1000, items[-1][1][:800])]
    bench = spark.createDataFrame(items[3:], "item_id long, text string")
    out = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=2000)
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in out.collect()) == [(n, n, 1.0) for n, _ in items[3:]]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "a b c d e f g h"),
                                  (5, "z " * 100000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "A, b c d e f g h!"), (8, None), (9, "?!"), (None, "a b c d e f g h")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(3, 7), (3, 7), (3, None), (3, None), (None, 7), (None, None)], key=repr)
    assert sorted(r["doc_id"] for r in dc.clean(docs, bench).collect()) == [1, 2, 5]
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), bench).count() == 0


def test_clean_judges_rows(spark):
    """Rows of one id, rows without an id, large ids beside them, and a column of the name used inside."""
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, "clean words here", "a"), (1, passage, "b"), (None, passage, "c"), (None, "other clean words", "d"), (2**60 + 1, "clean", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(2**60 + 3, passage), (None, "nothing of this")], "item_id long, text string")
    assert sorted(r["_row"] for r in dc.clean(docs, bench).collect()) == ["a", "d", "e"] and dc.clean(docs, bench).columns == docs.columns
    assert {r["item_id"] for r in dc.contaminated(docs, bench).collect()} == {2**60 + 3}
    assert dc.clean(docs, bench.limit(0)).count() == 5
