"""Repeated windows against a model that lists every window."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tallyforge.llm import substrings


def model(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,block", [(35, 4_000_000), (12, 3000), (5, 2000), (1, 500)])
def test_equals_model(spark, window, block):
    rng = random.Random(window)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage, copy = text(50), text(120)
    rows = [(i, text(rng.randrange(0, 150))) for i in range(60)]
    rows += [(100 + i, text(rng.randrange(20)) + "\n " + passage + "\t" + text(rng.randrange(20))) for i in range(20)]
    rows += [(200 + i, copy) for i in range(30)] + [(300, None), (301, ""), (302, " \n "), (None, "one"), (304, "same " * 400),
             (305, "x" * 70000 + " " + passage), (306, "é　ß " * 60), (307, passage[:-1]), (307, passage[:-1]), (2**60 + 1, "large id")]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, n_words int").repartition(3)
    got = substrings.remove_repeats(df, window=window, block_bytes=block, bucket_bytes=4000, keep_text=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == model(rows, window)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_minimiser_is_dealt_out(spark, monkeypatch, tmp_path):
    """One line of 20 words in other surroundings in every document, some of them whole copies: no group gets all of it."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    line, passage, folder, count = text(20), text(45), str(tmp_path), substrings._count

    def spied(window):
        def run(pdf):
            parts = [substrings._unpack(d) for d in pdf["data"]]
            with open(f"{folder}/{pdf['bucket'].iloc[0]}", "w") as file:
                file.write(str(sum(len(p[0]) for p in parts)))
            return count(window)(pdf)

        return run

    monkeypatch.setattr(substrings, "_count", spied)
    monkeypatch.setattr(substrings, "HOT_RUNS", 50, raising=False)
    rows = [(i, f"{text(40)} {line} {text(40)}") for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000 + i, f"{text(9)} {passage} {text(9)}") for i in range(200)]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(3)
    got = substrings.remove_repeats(df, block_bytes=20000, bucket_bytes=4000).collect()
    assert sorted(map(tuple, got), key=repr) == model(rows, 35)
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert max(sizes) < 400 * len(line) / 2
