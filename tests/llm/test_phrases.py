"""Phrases against a model that lists every run of words, and against SQL."""

import random
import re
from collections import Counter

import pytest

from tallyforge.llm import phrases


def model(rows, longest, least, top, inside=80):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault("und" if lang is None else lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        kept = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in kept.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                                  for q, b in kept.items()):
                continue
            score, k = min((2000000 * a // (kept[p[:k]] + kept[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), kept[p[:k]], kept[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, phrases.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("block,groups,longest", [(16_000_000, 1_000_000, 4), (700, 50, 4), (300, 20, 2), (2000, 100, 6)])
def test_equals_model(spark, block, groups, longest):
    rng = random.Random(block)
    words = ["the", "The", "of", "New", "york", "Ünï", "ünï", "x y", "a|b", "𝄞", "日本", "ﬁ"]
    fixed = ["new york city hall", "of the", "a|b 𝄞 日本 ﬁ ünï"]

    def text():
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(40))]
        return "".join(p + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "\r\n", ", ", "\x0b", ""]) for p in parts)

    rows = [(rng.choice(["en", "de", None, "und", ""]), text()) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", " .\n"), ("it", "only once here"), ("en", "new york " * 500)] + [("es", "una copia de la misma")] * 40
    df = spark.createDataFrame([(t, lang, 1, 2) for lang, t in rows], "text string, lang string, a int, n int").repartition(3)
    assert got(df, longest=longest, least=5, top=25, block_bytes=block, bucket_groups=groups) == model(rows, longest, 5, 25)


def test_nothing(spark):
    df = spark.createDataFrame([("en", "too few")], "lang string, text string")
    assert got(df) == [] and got(df.limit(0)) == []


def test_equals_sql(spark, tiny):
    import duckdb

    from tallyforge.llm.queries import OP12_SQL

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    rows = sorted(db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({OP12_SQL})").fetchall())
    assert rows and got(spark.read.parquet(f"{tiny}/documents.parquet")) == rows
