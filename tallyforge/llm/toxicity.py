"""Toxicity: a logistic classifier over words whose score must not move when identity terms are swapped.

The classifier is fitted on a bounded sample, drawn by hash from all labelled ids of the training folds. In how many toxic
and clean sampled documents a word or word beginning occurs decides which become features. For each sampled text that names a group, a counterfactual text names another one instead, and the
squared difference of their scores is added to the loss, so that naming a group is not evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.session import cut

THRESHOLD = 0.7
#: Words of this length or more also count by their beginning.
PREFIX = 5
FEATURES = 4096
#: Labelled ids of each class that the classifier is fitted on at most.
SAMPLE_ROWS = 10_000
#: Entries a partition counts before it hands them on.
COUNTED = 500_000
SWAP_PENALTY = 1.0
RIDGE = 1e-4

# Identity terms; a term is swapped with the next one of its line.
IDENTITY = [
    "women men",
    "woman man",
    "girls boys",
    "muslims christians jews hindus buddhists atheists",
    "muslim christian jewish hindu buddhist atheist",
    "gay straight lesbian bisexual transgender",
    "black white asian latino arab indigenous",
    "immigrants refugees foreigners natives",
    "mexicans africans chinese europeans americans",
    "old young",
    "disabled blind deaf autistic",
]
SWAP = {a: b for line in IDENTITY for a, b in zip(line.split(), line.split()[1:] + line.split()[:1])}
_WORD = re.compile(r"\w+")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:PREFIX] for w in words if len(w) >= PREFIX}


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next one, or None if it has none."""
    lower = text.lower()
    out = _WORD.sub(lambda m: SWAP.get(m[0], m[0]), lower)
    return None if out == lower else out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum(weights[f] for f in features(text) if f in weights)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _counts(labelled: DataFrame) -> DataFrame:
    """(feature, n, toxic) over all rows of (text, y); every partition counts before the shuffle."""

    def run(batches):
        n, toxic = Counter(), Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                found = features(text)
                n.update(found)
                if y:
                    toxic.update(found)
                if len(n) > COUNTED:
                    yield pd.DataFrame([(f, k, toxic[f]) for f, k in n.items()], columns=["feature", "n", "toxic"])
                    n, toxic = Counter(), Counter()
        if n:
            yield pd.DataFrame([(f, k, toxic[f]) for f, k in n.items()], columns=["feature", "n", "toxic"])

    parts = labelled.mapInPandas(run, "feature string, n long, toxic long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _sparse(rows: list[list[int]], width: int):
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.repeat(np.arange(len(rows)), sizes), np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum())), width


def fit(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int,
        penalty: float = SWAP_PENALTY, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum over all rows; both classes weigh the same in total."""
    at, feat, _ = _sparse(rows, width)
    left, right = _sparse([a for a, _ in pairs], width), _sparse([b for _, b in pairs], width)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b, m, v = np.zeros(width), 0.0, np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[feat], len(rows)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(feat, err[at], width) + RIDGE * w
        if pairs:
            gap = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
            gap *= 2 * penalty / len(pairs)
            g += np.bincount(left[1], gap[left[0]], width) - np.bincount(right[1], gap[right[0]], width)
        grad = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          n_features: int = FEATURES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``sample_rows`` labelled ids of each class outside the held-out fold.

    Null labels and unlabelled rows are not used; a document with several labels counts as toxic if one says so. Without
    a row of both classes the model scores every text with the share of toxic rows (0 without any).
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for y in (0, 1)]
    drawn = cut(drawn[0].unionByName(drawn[1]), "drawn")  # at most 2 * sample_rows pairs of numbers, so it can be broadcast
    labelled = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id"), "labelled")
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    n, toxic = total["n"], total["toxic"]
    if not toxic or toxic == n:
        p = min(max(toxic / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return Model({}, float(np.log(p / (1 - p))))
    t, c = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    odds = F.log(t / (toxic + 1 - t)) - F.log(c / (n - toxic + 1 - c))
    z = F.abs(odds) / F.sqrt(1 / t + 1 / c)
    best = _counts(labelled).withColumn("z", z).filter("z >= 2").orderBy(F.desc("z"), "feature").limit(n_features)
    names = sorted({r["feature"] for r in best.select("feature").collect()} | set(SWAP))
    index = {f: i for i, f in enumerate(names)}

    def to_rows(batches):
        for pdf in batches:
            out = []
            for h, text, y in zip(pdf["h"], pdf["text"], pdf["y"]):
                other = swapped(text) if text else None
                row = sorted(index[f] for f in features(text) if f in index)
                out.append((h, int(y), row, None if other is None else sorted(index[f] for f in features(other) if f in index)))
            yield pd.DataFrame(out, columns=["h", "y", "row", "other"])

    sample = labelled.select(F.xxhash64("_id", "text").alias("h"), "text", "y").mapInPandas(
        to_rows, "h long, y int, row array<int>, other array<int>").orderBy("h").limit(4 * sample_rows).collect()
    pairs = [(r["row"], r["other"]) for r in sample if r["other"] is not None]
    pairs += [([index[a]], [index[b]]) for a, b in SWAP.items()]  # a bare mention, for terms the sample lacks
    w, b = fit([r["row"] for r in sample], np.array([r["y"] for r in sample], float), pairs, len(names))
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default) with score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts get the score of a text without features. Columns of ``docs`` named score or predicted are
    replaced. An empty table gives no rows.
    """
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype(float)

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in names], scored(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype(float)

    return docs.filter(scored(F.col(text_col)) < THRESHOLD)
