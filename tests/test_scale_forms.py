"""The forms for long groups and many copies against brute force on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tallyforge.functions import similarity as sim
from tallyforge.operators import shortlist
from tallyforge.operators.ranking import with_rank
from tallyforge.operators.skewjoin import checked_merge, salted_join
from tallyforge.operators.splitwindow import OrderedParts, sessions
from tallyforge.plans import evaluation as ev, preparation as pr
from tallyforge.settings import Settings


@pytest.fixture(scope="module")
def skewed(spark):
    """2000 rows, a third of them of one user."""
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), i, rng.randrange(100_000), rng.choice([None, i])) for i in range(2000)]
    return spark.createDataFrame(rows, "u int, id int, ts long, v int").repartition(6)


def test_rank_of_long_groups(skewed):
    small = Settings(max_window_rows=50)
    got = with_rank(skewed, ["u"], ["ts", "id"], "r", small).select("id", "r")
    want = skewed.select("id", F.row_number().over(Window.partitionBy("u").orderBy("ts", "id")).cast("long").alias("r"))
    assert got.exceptAll(want).isEmpty() and got.count() == 2000


def test_windows_over_parts(skewed):
    w = Window.partitionBy("u").orderBy("ts", "id")
    got = (OrderedParts(skewed, ["u"], ["ts", "id"]).lag("p", F.col("v")).forward_fill("f", F.col("v"))
           .running_sum("s", F.col("ts")).result().select("id", "p", "f", "s"))
    want = skewed.select(
        "id", F.lag("v").over(w).alias("p"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"),
        F.sum("ts").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_sessions(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "u int, id int, t string").withColumn("ts", F.to_timestamp("t"))
    got = sessions(df, ["u"], "ts", "id", 1800).orderBy("id").collect()
    assert [r.session_no for r in got] == [1, 1, 2]


def test_salted_join_equals_join(spark, skewed):
    one = spark.range(40).select(F.col("id").cast("int").alias("u"), (F.col("id") * 2).alias("x"))
    got = salted_join(skewed, one, "u", hot_rows=100, salts=4).select("id", "x")
    assert got.exceptAll(skewed.join(one, "u").select("id", "x")).isEmpty() and got.count() == 2000


def test_checked_merge_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        checked_merge(a, b, ["k"], "1:1")
    assert checked_merge(a, b, ["k"], "m:1").count() == 2


def brute_shortlist(records, pool, k=3):
    out = []
    for rid, ref, name in records:
        scored = []
        for pid, pref, pname, pos in pool:
            r = sim.reference_similarity(ref, pref)
            n = sim.indel(" ".join(sorted(name.split())), " ".join(sorted(pname.split())))
            s = max(r, 0.7 * r) if r >= 0.75 else 0.4 * r + 0.3 * n
            if s >= 0.35:
                scored.append((-round(s, 4), pos, pid, r))
        out += [(rid, pid, r) for _, _, pid, r in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shortlist_equals_brute_force_for_near_references(spark, seed):
    """Same length references, dense numbers: the whole shortlist lies within the edit neighbourhoods."""
    rng = random.Random(seed)
    number = lambda: f"REF{rng.randrange(300):09d}"
    hot = "REF000000007"  # a third of both sides
    records = [(f"S{i}", hot if i % 3 == 0 else number(), "A B") for i in range(60)]
    pool = [(f"O{i}", hot if i % 3 == 0 else number(), rng.choice(["A B", "C"]), i) for i in range(240)]
    got = shortlist.shortlist(
        spark.createDataFrame(records, "id string, ref string, name string"),
        spark.createDataFrame(pool, "id string, ref string, name string, pos int")).collect()
    assert sorted((r.record_id, r.candidate_id) for r in got) == sorted((a, b) for a, b, _ in brute_shortlist(records, pool))


def test_texts_near_others_are_found_by_what_they_have_in_common(monkeypatch):
    """All pairs that reach a floor, and no others; few of the beginnings are looked at."""
    rng = random.Random(6)
    kinds = [lambda: f"REF{rng.randrange(2000):09d}", lambda: f"REF{rng.randrange(2000)}", lambda: "0" * rng.randrange(1, 4) + str(rng.randrange(50)),
             lambda: "".join(rng.choice("AB01") for _ in range(rng.randrange(1, 9))),
             lambda: "".join(rng.choice("ABÉ012-") for _ in range(rng.choice([5, 20, 66])))]
    for front in (5, 1000, 1_000_000):
        monkeypatch.setattr(sim, "FRONT", front)
        texts, asking = (sorted({rng.choice(kinds)() for _ in range(n)}) for n in (60, 15))
        floors = [rng.choice([0.75, 0.8, 0.8332, 0.9, 0.9165, 1.0]) for _ in asking]
        want = {(i, j): s for i, a in enumerate(asking) for j, p in enumerate(texts) if (s := sim.reference_similarity(a, p)) >= floors[i]}
        who, text, score = sim.Near(texts).pairs(asking, floors)
        assert dict(zip(zip(who.tolist(), text.tolist()), score.tolist())) == pytest.approx(want) and len(who) == len(want)


def test_shortlist_of_open_references_lists_few_pairs_a_block(spark, monkeypatch):
    """References written without their zeros stay open; what they meet is held back to k texts of a block, and no name is compared."""
    rng = random.Random(8)
    records = [(f"S{i}", f"REF{rng.randrange(1000, 3000)}", "A") for i in range(40)] + [(f"T{i}", f"REF{rng.randrange(3000):09d}", "A") for i in range(40)]
    pool = [(f"O{i}", f"REF{n:09d}", "C", i) for i, n in enumerate(rng.sample(range(0, 3000, 7), 300))]
    monkeypatch.setattr(shortlist, "SEARCH_LEAST", 10)
    monkeypatch.setattr(shortlist, "SEARCH_BLOCK", 70)
    monkeypatch.setattr(shortlist, "SEARCH_BATCH", 7)
    real, compared = shortlist.compared, []
    monkeypatch.setattr(shortlist, "compared", lambda records, *a: compared.append(records.count()) or real(records, *a))
    got = shortlist.shortlist(
        spark.createDataFrame(records, "id string, ref string, name string"),
        spark.createDataFrame(pool, "id string, ref string, name string, pos int")).collect()
    assert sorted((r.record_id, r.candidate_id) for r in got) == sorted((a, b) for a, b, _ in brute_shortlist(records, pool))
    assert sum(compared) < 5


def test_shortlist_equals_brute_force_for_far_references(spark, monkeypatch):
    """References with little in common, equal and similar names, missing names, hot names: the whole list of every record."""
    rng = random.Random(4)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    far = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 16)))
    names = ["Acme Trading Ltd", "Ltd Acme Trading", "Acme Tradng", "Zenith Foods", "B", "", None, "Órbita S.A."]
    records = [(f"S{i}", rng.choice([far(), "REF000000123", "same far text"]), "Acme Trading Ltd" if i % 3 == 0 else rng.choice(names)) for i in range(120)]
    pool = [(f"O{i}", far() if i % 4 else "REF%09d" % rng.randrange(500), "Acme Trading Ltd" if i % 3 == 0 else rng.choice(names), i) for i in range(400)]
    monkeypatch.setattr(shortlist, "CHUNK", 30)
    monkeypatch.setattr(shortlist, "BLOCK", 70)
    got = shortlist.shortlist(
        spark.createDataFrame(records, "id string, ref string, name string").repartition(3),
        spark.createDataFrame(pool, "id string, ref string, name string, pos int").repartition(3)).collect()
    want = {}
    for rid, ref, name in records:
        scored = []
        for pid, pref, pname, pos in pool:
            r = sim.reference_similarity(ref.upper(), pref)
            n = sim.indel(" ".join(sorted(name.split())), " ".join(sorted(pname.split()))) if name and pname else 0.0
            s = r if r >= 0.75 else 0.4 * r + 0.3 * n
            if s >= 0.35:
                scored.append((-round(s, 4), pos, pid, round(r, 4), round(n, 4)))
        want[rid] = [(pid, -s, r, n) for s, _, pid, r, n in sorted(scored)[:3]]
    listed = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        listed.setdefault(r.record_id, []).append((r.candidate_id, r.similarity_score, r.ref_score, r.name_score))
    assert listed == {k: v for k, v in want.items() if v}
    assert any(0 < s < 0.75 for v in want.values() for _, s, _, _ in v)


def test_reference_scores_equal_the_ratios_one_by_one():
    rng = random.Random(1)
    make = lambda: "x" * rng.randrange(70) if rng.random() < 0.1 else "".join(
        rng.choice(["REF", "0", "1", "2", "é", "A", "-", "日"]) for _ in range(rng.randrange(14)))
    texts = [make() for _ in range(300)]
    references, plain = sim.References(texts), sim.Texts(texts)
    for _ in range(60):
        a = make()
        assert np.allclose(references.scores(a), [sim.reference_similarity(a, b) for b in texts], atol=1e-12)
        assert np.allclose(sim.indel_to_all(a, plain), [sim.indel(a, b) for b in texts], atol=1e-12)


def test_near_copies_keep_first(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        base = rng.sample(words, 60)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(60)] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 60 + ["", ""]
    rng.shuffle(texts)
    kept, want = [], []
    for i, s in enumerate(texts):
        mine = set(s.lower().split())
        if not any((mine == o) or (mine and o and len(mine & o) / len(mine | o) >= 0.8) for o in kept):
            kept.append(mine)
            want.append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted(r.id for r in pr.drop_near_copies(df, "id", F.col("text")).collect())
    assert got == want


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "chunk_blocks": 2, "meeting_blocks": 3, "pivot_rows": 60}])
def test_neighbours_equal_brute_force(spark, sizes):
    """Clusters, far vectors, a third of the rows one vector, zero vectors, null and odd ones; every path exact."""
    rng = np.random.default_rng(5)
    x = [*np.repeat(rng.standard_normal((25, 16)), 20, axis=0) + 0.05 * rng.standard_normal((500, 16)), *rng.standard_normal((150, 16))]
    x += [x[3]] * 330 + [x[9] * 2, np.zeros(16), np.zeros(16)]
    ids = rng.permutation(len(x)) + 2**60
    rows = [(int(i), [float(c) for c in v], 1.0) for i, v in zip(ids, x)]
    odd = [(1, None, 0.0), (2, [], 0.0), (3, [float("nan")] * 16, 0.0), (4, [None] + [1.0] * 15, 0.0), (None, [1.0] * 16, 0.0)]
    df = spark.createDataFrame(rows + odd, "id long, vector array<double>, score double").repartition(5)
    got = {}
    for r in pr.neighbours(df, 4, **sizes).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.score)
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in x])
    sims = np.round(unit @ unit.T, 9)
    assert set(got) == {int(i) for i in ids}
    for at, i in enumerate(ids):
        want = sorted((-s, int(o)) for s, o in zip(sims[at], ids) if o != i)[:4]
        mine = [got[i][r] for r in range(1, 5)]
        assert [round(s, 9) for _, s in mine] == [-s for s, _ in want]
        assert all(round(float(sims[at, np.flatnonzero(ids == o)[0]]), 9) == round(s, 9) for o, s in mine)
        assert not (sims[at] == 1).all() or [o for o, _ in mine] == [o for _, o in want]
    copies = sorted(int(i) for i, v in zip(ids, x) if (v == x[3]).all())
    assert [got[copies[9]][r][0] for r in range(1, 5)] == copies[:4]
    assert pr.neighbours(df.limit(0), 4).count() == 0


def test_exact_quantiles(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 50, 333)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = {r.p: r.value for r in ev.exact_quantiles(df, "v", [0, 0.1, 0.5, 0.77, 1]).collect()}
    for p, v in got.items():
        assert abs(v - np.percentile(values, p * 100)) < 1e-9


def test_chunks(spark):
    rng = random.Random(2)
    s = " ".join("x" * rng.randrange(1, 12) for _ in range(400))
    got = spark.createDataFrame([(s,), ("",)], "t string").select(pr.fixed_chunks(F.col("t"), 100, 10).alias("c")).collect()
    assert got[1].c == [] and all(len(c) <= 100 for c in got[0].c)
    assert got[0].c[0] == s[:100][: s[:100].rfind(" ")] if s[:100].rfind(" ") > 80 else s[:100]
    assert s.endswith(got[0].c[-1])
