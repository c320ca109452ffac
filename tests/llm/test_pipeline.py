"""The pipeline: every stage against a model on its own input, and run() against the stages in turn."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tallyforge.llm import decontaminate, toxicity
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import model as simhash_model
from tests.llm.test_toxicity import made_up

MAIL, CARD = "bosbt.42@mail8.example.com", "4041894974608795"
DOCUMENTS = {"doc_id": "Int64", "text": "string", "lang": "string", "source": "string", "n_chars": "Int64", "fp": "Int64"}


def corpus(folder):
    """Documents with toxic rows, copies, benchmark passages and personal data, and what each row was made for."""
    rng = random.Random(11)
    known = made_up(rng, 600)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.randrange(12, 30))) for k in range(8)]
    rows, made = [(i, t) for i, t, _ in known], {i: "toxic" if y else "clean" for i, _, y in known}

    def add(kind, body):
        made[1000 + len(rows)] = kind
        rows.append((1000 + len(rows), body))

    for k in range(6):
        base = text(200)
        for body in [base, base, base.upper()][:1 + k % 3]:
            add("copies", body)
    for _, passage in items:
        add("leak", f"{text(20)}. {passage.upper()}, {text(30)}")
        words = passage.split()
        words[len(words) // 2] = "changed"
        add("edited leak", f"{text(25)} {' '.join(words)} {text(10)}")
    for _ in range(4):
        add("personal", f"{text(30)} {MAIL} or {CARD} {text(30)}")
    add("clean", text(3000))
    rows += [(5000, None), (5001, ""), (None, text(40))]
    docs = pd.DataFrame([(i, t, "en", "s", None if t is None else len(t), 7) for i, t in rows], columns=list(DOCUMENTS)).astype(DOCUMENTS)
    docs.to_parquet(f"{folder}/documents.parquet", index=False)
    labels = pd.DataFrame([(i, 1, y) for i, _, y in known], columns=["doc_id", "quality", "toxic"])
    labels.to_parquet(f"{folder}/labels.parquet", index=False)
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(f"{folder}/benchmark.parquet", index=False)
    return made, items


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=repr)


def test_stages_and_run(spark, tmp_path):
    made, items = corpus(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kinds = lambda rows: [made.get(i) for i, _ in rows]

    model, before = toxicity.train(docs, labels), as_rows(docs)
    out = stage["toxicity"](spark, docs, str(tmp_path)).cache()
    kept = as_rows(out)
    assert out.columns == docs.columns and kept == [r for r in before if model.score(r[1]) < toxicity.THRESHOLD]
    assert kinds(kept).count("toxic") <= 0.02 * kinds(before).count("toxic")
    assert len([k for k in kinds(kept) if k != "toxic"]) >= 0.98 * len([k for k in kinds(before) if k != "toxic"])

    before, out = kept, stage["simhash_near_dedup"](spark, out, str(tmp_path)).cache()
    first = {i: component for i, _, component in simhash_model(before) if i is not None}
    kept = as_rows(out)
    assert out.columns == docs.columns and kept == [r for r in before if r[0] is None or first[r[0]] == r[0]]

    before, out = kept, stage["benchmark_decontamination"](spark, out, str(tmp_path)).cache()
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower())).encode()
    close = lambda t: any(decontaminate.edit_distance_inside(p.encode(), plain(t)) <= 0.2 * len(p) for _, p in items)
    holds = {r: close(r[1]) for r in before}
    kept = as_rows(out)
    assert out.columns == docs.columns and [r for r in kept if not holds[r]] == [r for r in before if not holds[r]]
    assert {"leak", "edited leak"} <= {made.get(i) for (i, _), hit in holds.items() if hit}
    assert "leak" not in kinds(kept) and len([r for r in kept if holds[r]]) <= 0.1 * sum(holds.values())

    before, out = kept, stage["pii_pseudonyms"](spark, out, str(tmp_path)).cache()
    kept = as_rows(out)
    assert out.columns == docs.columns and [i for i, _ in kept] == [i for i, _ in before]
    assert [r for r, kind in zip(kept, kinds(kept)) if kind != "personal"] == [r for r in before if made.get(r[0]) != "personal"]
    named = [(t, dict(before)[i]) for i, t in kept if made.get(i) == "personal"]
    found = {re.search(r"(\S+@\S+) or (\d{16}) ", t).groups() for t, _ in named}
    assert named and len(found) == 1 and not {MAIL, CARD} & set(*found)  # equal values stay linked
    assert all(re.sub(r"\S+@\S+ or \d{16}", "", t) == re.sub(r"\S+@\S+ or \d{16}", "", old) for t, old in named)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts, by_sequence, lengths = kept, {}, {}
    assert {p["doc_id"] for p in pieces} == {i for i, _ in texts}
    ids = {i: ids_of(t) for i, t in texts}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        lengths[p["doc_id"]] = lengths.get(p["doc_id"], 0) + p["length"]
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert lengths == {i: len(x) for i, x in ids.items()}
    for parts in by_sequence.values():
        ends = [0] + [at + n for at, n in sorted(parts)]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


@pytest.mark.parametrize("name", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, name):
    docs = pd.DataFrame([(1, "some words here", "en", "s", 15, 7)], columns=list(DOCUMENTS)).astype(DOCUMENTS)
    tables = {"documents": docs, "labels": pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}),
              "benchmark": pd.DataFrame({"item_id": [1], "text": ["something else"]}).astype({"text": "string"})}
    for each, rows in tables.items():
        (rows.iloc[:0] if each == name else rows).to_parquet(f"{tmp_path}/{each}.parquet", index=False)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [r["doc_id"] for r in got.collect()] == ([] if name == "documents" else [1])
