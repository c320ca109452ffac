"""Language identification by string kernels.

A text is the set of its byte n-grams of 2 to 4 bytes (blended spectrum, presence only, folded into ``DIMENSIONS``); the
kernel of two texts is the share of common n-grams, |A and B| / sqrt(|A| |B|). Landmarks of the training sample give the
Nyström map, kernel ridge regression one weight vector per language, and texts are scored batch by batch as matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 1 << 14
SPECTRUM = (2, 3, 4)
LANDMARKS = 256
#: Training rows the ridge is fitted on, about; every language has an equal share, or all it has.
SAMPLE_ROWS = 4000
RIDGE = 1e-2
#: Texts scored by one matrix product.
BATCH = 256
_SLICE = 1 << 20
#: Letters as Unicode has them, alike here and in column expressions.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def presence(text: str | None) -> np.ndarray:
    """Flags of the n-grams that occur in the lower-cased text."""
    flags = np.zeros(DIMENSIONS, bool)
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(data), _SLICE):
        part = data[at:at + _SLICE + max(SPECTRUM) - 1].astype(np.uint32)
        code = part
        for n in range(2, max(SPECTRUM) + 1):
            if len(part) < n:
                break
            code = (code[:-1] << np.uint32(8)) | part[n - 1:]
            if n in SPECTRUM:
                flags[(code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> shift] = True
    return flags


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Presence kernel of rows of flags; an empty set has 0 with everything."""
    common = left.astype(np.float32) @ right.astype(np.float32).T
    size = np.sqrt(left.sum(1, dtype=np.float32)[:, None] * right.sum(1, dtype=np.float32)[None, :])
    return common / np.maximum(size, 1)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray  # of the kernel values with the landmarks

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of every text; ("und", 0.0) without a letter or without learned languages."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        at = [i for i, t in enumerate(texts) if self.languages and t and _LETTER.search(t)]
        right, size = self.landmarks.astype(np.float32).T, np.sqrt(self.landmarks.sum(1, dtype=np.float32))
        for lo in range(0, len(at), BATCH):
            part = at[lo:lo + BATCH]
            left = np.zeros((len(part), DIMENSIONS), np.float32)
            for row, i in enumerate(part):
                left[row] = presence(texts[i])
            k = (left @ right) / np.maximum(np.sqrt(left.sum(1))[:, None] * size[None, :], 1)
            margin = k @ self.weights
            best = margin.argmax(1)
            for i, b, m in zip(part, best.tolist(), margin.max(1).tolist()):
                out[i] = self.languages[b], min(max((1 + m) / 2, 0.0), 1.0)
        return out


def fit(flags: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge on the Nyström map; the landmarks are taken from the languages in turn."""
    languages = sorted(set(lang))
    turn, seen = [], dict.fromkeys(languages, 0)
    for name in lang:
        turn.append(seen[name])
        seen[name] += 1
    chosen = flags[np.lexsort((np.arange(len(lang)), turn))[:landmarks]]
    value, vector = np.linalg.eigh(kernel(chosen, chosen).astype(float))
    keep = value > 1e-6 * max(value.max(), 1e-12)
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    x = kernel(flags, chosen).astype(float) @ nystrom
    y = np.where(np.array(lang)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    return Model(languages, chosen, (nystrom @ w).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Learns from text and language of the rows outside the held-out fold; null languages and texts without a letter
    are not used. Without any row the model answers "und"."""
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMENSIONS), bool), np.zeros((0, 0), np.float32))
    share = {k: min(1.0, sample_rows / len(counts) / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 40)))])
    drawn = known.filter(F.pmod(F.xxhash64("id", "text", "lang"), F.lit(1 << 40)) < limit[F.col("lang")])

    def flagged(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "flags": [np.packbits(presence(t)).tobytes() for t in pdf["text"]]})

    drawn = drawn.orderBy(F.xxhash64("id", "text", F.lit(1))).limit(2 * sample_rows + 100 * len(counts))
    rows = sorted(drawn.mapInPandas(flagged, "lang string, flags binary").collect(), key=lambda r: (bytes(r["flags"]), r["lang"]))
    order = np.random.default_rng(0).permutation(len(rows))
    flags = np.array([np.unpackbits(np.frombuffer(rows[i]["flags"], np.uint8)).astype(bool) for i in order]).reshape(-1, DIMENSIONS)
    return fit(flags, [rows[i]["lang"] for i in order], landmarks)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row, whole texts; null texts and those without a letter are "und"."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            found = shared.value.predict(list(pdf["text"]))
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf["held_out"], "lang_pred": [f[0] for f in found],
                                "score": [float(f[1]) for f in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    # Ids travel as text, which keeps large ones beside nulls.
    return docs.select(F.col(id_col).cast("string").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, held_out boolean, lang_pred string, score double").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
