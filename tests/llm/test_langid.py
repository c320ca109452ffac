"""Language identification: the kernel by definition, and held-out accuracy."""

import random

import numpy as np

from tallyforge.llm import langid

SYLLABLES = {"aa": "ka to mi ne ru", "bb": "schl ung ver keit ü", "cc": "ção nha lo de que"}


def corpus(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((" ".join(words).title(), lang, i))
    return rows


def test_kernel_counts_common_grams():
    grams = lambda b: {b[i:i + n] for n in (2, 3, 4) for i in range(len(b) - n + 1)}
    a, b = "the cat sat", "the mat sat on"
    k = langid.kernel(np.array([langid.presence(a)]), np.array([langid.presence(b)]))[0, 0]
    x, y = grams(a.encode()), grams(b.encode())
    assert abs(k - len(x & y) / (len(x) * len(y)) ** 0.5) < 0.02  # up to folding
    long = "abc " * (1 << 19)
    assert (langid.presence(long) == langid.presence("abc " * 3)).all()


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(random.Random(1), 1500)
    odd = [(None, "aa", 9001), ("", "aa", 9002), ("123 !?", "bb", 9003), ("kato", None, 9004), ("x " * 100000, None, 9005)]
    docs = spark.createDataFrame(rows + odd, "text string, lang string, doc_id long")
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert len(out) == 1505 and all(0 <= r["score"] <= 1 for r in out.values())
    unseen = [(i, lang) for _, lang, i in rows if out[i]["held_out"]]
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in unseen]) > 0.99
    assert [out[i]["lang_pred"] for i in (9001, 9002, 9003, 9004)] == ["und", "und", "und", "aa"]
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(20), none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_only_letters_make_a_language(spark):
    """Numbers that are no letters give und, in learning and predicting; large ids beside a null stay."""
    rows = [(i, "the words of one language " * 3, "en") for i in range(20)] + [(100 + i, "die Wörter einer anderen Sprache " * 3, "de") for i in range(20)]
    rows += [(2**60 + 1, "½ ² Ⅷ 12", "en"), (None, "the words", "en"), (3000, "_ 5", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[2**60 + 1] == "und" and got[3000] == "und" and got[None] == "en" and got[101] == "de"
