"""SimHash near-duplicates against a model that compares every pair."""

import random

import numpy as np
import pytest
import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.components import components


def model_print(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model(rows, distance=4):
    prints = [(i, model_print(t)) for i, t in rows]
    group = list(range(len(prints)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                group[top(i)] = top(j)
    out = []
    for i, (doc, fp) in enumerate(prints):
        members = [prints[j][0] for j in range(len(prints)) if top(j) == top(i) and prints[j][0] is not None]
        out.append((doc, f"{fp:016x}", min(members, default=None)))
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_equals_model(spark):
    rng = random.Random(7)
    base = words(rng, 300)
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(40)]
    for i in range(40, 80):
        w = base.split()
        w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \t\n"), (93, "One"), (94, "oNE"), (95, "É é"), (95, "É é"), (None, base), (97, "x" * 70000),
             (98, "a b c"), (99, base.upper().replace(" ", "\t"))]
    got = simhash.near_duplicates(spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, start int"))
    assert sorted(map(tuple, got.collect()), key=repr) == model(rows)


@pytest.mark.parametrize("limit", [4096, 3])
def test_chains_find_every_link(spark, limit):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(0, 6)):
            x ^= 1 << b
        fps.append(x)
    signed = np.array(sorted(set(fps)), "uint64").view("int64").tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    want = {}
    for x in signed:
        want.setdefault(x, x)
    for x in signed:
        for y in signed:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4 and want[x] != want[y]:
                old = want[y]
                want = {k: want[x] if v == old else v for k, v in want.items()}
    pairs = lambda m: {(x, y) for x in signed for y in signed if m.get(x, x) == m.get(y, y)}
    assert pairs(roots) == pairs(want)


def test_empty_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (5, "other words", "z")], empty.schema)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [2, 5]


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {}
    for r in components(path).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [2, 201]


def test_one_of_each_judges_rows(spark):
    """Repeated ids of other texts, equal rows, null ids, large ids beside them: one row of every component stays."""
    x, y = "the first text has these words " * 3, "quite another text with other words in it " * 3
    rows = [(1, x, "a"), (2, x, "b"), (0, y, "c"), (1, y, "d"), (None, x, "e"), (2**60 + 1, "large " * 9, "f"), (2**60 + 1, "large " * 9, "f"),
            (None, "only one without id " * 4, "g"), (None, None, "h"), (5, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(3)
    kept = simhash.one_of_each(docs)
    got = sorted((r["_row"], r["doc_id"]) for r in kept.collect() if r["_row"] != "g")
    assert got == [("a", 1), ("c", 0), ("f", 2**60 + 1), ("i", 5)] and kept.filter("_row = 'g'").count() == 1
    assert kept.columns == docs.columns and simhash.one_of_each(docs.limit(0)).count() == 0
    found = {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found == {0, 1, 2, 5, None, 2**60 + 1}
