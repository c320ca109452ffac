"""Alignments against a model that compares all byte ranges."""

import hashlib
import random
from collections import Counter

import pytest

from tallyforge.llm import alignment


def tokens(text):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return [], []
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found = t.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte[c] for c in s)) for i, s in zip(found.ids, found.tokens)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
         for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])


def model(rows):
    def ranges(found):
        out, at = [], 0
        for i, x in found:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    docs = []
    for doc, text in rows:
        a, b = map(ranges, tokens(text))
        links = [(i, k) for i, s, e in a for k, u, v in b if s < v and u < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(",".join(str(i) for i, _, e in a if low < e <= high) + "|" + ",".join(str(i) for i, _, e in b if low < e <= high))
                  for low, high in zip([0] + ends, ends)]
        docs.append((doc, a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return sorted(((doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc, a, b, groups, links in docs), key=repr)


def got(df, **options):
    return sorted(map(tuple, alignment.align(df, **options).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("block", [6_000_000, 300])
def test_equals_model(spark, tiny, block):
    rng = random.Random(block)
    words = ["the", "straße", "naïve", "日本語", "<|endoftext|>", "<s>", "<0x41>", "x" * 40, "12345", "…", "\n\n", "  ", "\t", "🙂", "'ll", "▁", "\x00"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(40)]
    rows += [(2**60 + 1, "large id"), (None, "no id"), (None, None), (50, None), (51, ""), (52, " "), (53, "same"), (53, "same"), (54, "x" * 3000),
             (55, "ﬁ ① é"), (56, "line one\r\nline two ")]
    rows += [(1000 + r.doc_id, r.text[:400]) for r in spark.read.parquet(f"{tiny}/documents.parquet").filter("doc_id < 30").collect()]
    df = spark.createDataFrame([(t, i, 1, "c") for i, t in rows], "text string, doc_id long, n_a int, pairs string").repartition(3)
    assert got(df, block_bytes=block) == model(rows)


def test_groups_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(df, keep_groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and rows[2].groups == ""
    assert alignment.align(df.limit(0)).count() == 0
