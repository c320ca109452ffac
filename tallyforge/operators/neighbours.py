"""Exact nearest neighbours by cosine, on one path at every size.

Equal vectors are one class, so copies are searched once. Classes are ordered by their nearest pivot and the distance to it
and cut into chunks of queries and, inside them, blocks of candidates with a centroid and a radius. Every chunk first finds
the best of its own vectors, which gives each class a bound; the bounds then decide which blocks of other chunks can still
hold something better (triangle inequality: first per pivot, then per block, then per class), and only those travel to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.session import cut

#: Candidates of a block, blocks of a chunk, blocks that meet a chunk in one task, and pivots at most.
BLOCK_ROWS, CHUNK_BLOCKS, MEETING_BLOCKS, MOST_PIVOTS = 1024, 8, 32, 1024
#: A block travels once for each chunk, so chunks grow with the rows once there are so many of them, up to so many blocks.
CHUNKS, MOST_CHUNK_BLOCKS = 12, 64
#: Classes that one pivot stands for, about.
PIVOT_ROWS = 1000
#: What sums of doubles may differ by.
SLACK = 1e-9
_BLOCK = "chunk long, block long, pivot int, n int, ids binary, vectors binary, centroid array<double>, radius double, cover double"
_TOPS = "cls long, other long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def _assign(pivots: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
                near = x @ pivots.T
                pivot = near.argmax(1)
                away = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), pivot]))
                yield pd.DataFrame({"cls": pdf["cls"], "pivot": pivot.astype(np.int32), "away": away, "unit": [v.tobytes() for v in x]})

    return run


def _blocks(block_rows: int, chunk_blocks: int):
    """Blocks of consecutive classes of one pivot; the partition's blocks are dealt to chunks in turn."""

    def block(number: int, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(u, np.float64) for u in frame["unit"]])
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        task = TaskContext.get().partitionId() << 33
        return pd.DataFrame([(task + number // chunk_blocks, task + number, int(frame["pivot"].iloc[0]), len(x),
                             frame["cls"].to_numpy(np.int64).tobytes(), x.tobytes(), centre, radius, float(frame["away"].max()))],
                           columns=["chunk", "block", "pivot", "n", "ids", "vectors", "centroid", "radius", "cover"])

    def run(batches):
        number, held = 0, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held):
                mine = int((held["pivot"] == held["pivot"].iloc[0]).sum())
                if mine == len(held) < block_rows:
                    break  # more of this pivot may follow
                yield block(number, held.iloc[:min(mine, block_rows)])
                number, held = number + 1, held.iloc[min(mine, block_rows):]
        if held is not None and len(held):
            yield block(number, held)

    return run


class _Best:
    """The ``k`` best candidates of each query so far, by score and then by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.other = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """``sims[i, j]`` is the score of query ``which[i]`` and candidate ``ids[j]``."""
        least = self.score[which, -1][:, None]
        hit = (sims > least) | ((sims == least) & (ids[None, :] < self.other[which, -1][:, None]))
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return
        at, taken = which[some], np.where(hit[some], sims[some], -np.inf)
        if taken.shape[1] > 2 * self.k:
            limit = np.partition(taken, taken.shape[1] - self.k, axis=1)[:, -self.k][:, None]
            taken = np.where(taken >= limit, taken, -np.inf)
        row, col = np.nonzero(taken > -np.inf)
        old = np.repeat(np.arange(len(at)), self.k)
        row, score, other = np.concatenate((old, row)), np.concatenate((self.score[at].ravel(), taken[row, col])), np.concatenate((self.other[at].ravel(), ids[col]))
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[at[row[keep]], place[keep]], self.other[at[row[keep]], place[keep]] = score[keep], other[keep]

    def rows(self, ids: np.ndarray, known: np.ndarray | None = None) -> pd.DataFrame:
        """What is held; without the others that were ``known`` of a query."""
        new = np.isfinite(self.score)
        if known is not None:
            for at in range(0, len(new), 4096):
                new[at:at + 4096] &= ~(self.other[at:at + 4096, :, None] == known[at:at + 4096, None, :]).any(2)
        row, col = np.nonzero(new)
        return pd.DataFrame({"cls": ids[row], "other": self.other[row, col], "score": self.score[row, col]})


def _search(best: _Best, queries: np.ndarray, which: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    for at in range(0, len(which), 512):
        some = which[at:at + 512]
        best.offer(some, queries[some] @ x.T, ids)


def _own(k: int):
    """One row a chunk: its classes, vectors, best scores and others so far, and a summary for each of its blocks."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in pdf["ids"]])
        x = np.concatenate([_matrix(v, n) for v, n in zip(pdf["vectors"], pdf["n"])])
        best = _Best(len(ids), k)
        first = 0
        for n in pdf["n"]:
            _search(best, x, np.arange(len(x)), x[first:first + n], ids[first:first + n])
            first += n
        ends = np.cumsum(pdf["n"].to_numpy())
        worst = [float(best.score[e - n:e, -1].min()) for e, n in zip(ends, pdf["n"])]
        return pd.DataFrame([(key[0], ids.tobytes(), x.tobytes(), best.score.tobytes(), best.other.tobytes(), np.stack(pdf["centroid"].to_numpy()).tolist(),
                              pdf["radius"].tolist(), worst)],
                            columns=["chunk", "ids", "vectors", "score", "other", "centroids", "radii", "worst"])

    return run


def _reach(worst: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How far from its centroid a block's classes can have something better; no bound (-inf) reaches everything."""
    return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(worst, -1))) + radius + SLACK


def _pivots_in_reach(pivots: np.ndarray, radii: np.ndarray):
    def run(batches):
        for pdf in batches:
            for chunk, centroids, radius, worst in zip(pdf["chunk"], pdf["centroids"], pdf["radii"], pdf["worst"]):
                for centre, reach in zip(centroids, _reach(np.array(worst), np.array(radius))):
                    centre = np.array(centre)
                    hit = np.flatnonzero(np.sqrt(((pivots - centre) ** 2).sum(1)) <= reach + radii)
                    yield pd.DataFrame({"chunk": chunk, "pivot": hit.astype(np.int32), "centre": [centre] * len(hit), "reach": reach})

    return run


def _others(k: int):
    """The better candidates of a chunk's classes among the blocks that came to it; those of its own blocks are known."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"cls": [], "other": [], "score": []})
        q = left.iloc[0]
        ids = np.frombuffer(q["ids"], np.int64)
        x = _matrix(q["vectors"], len(ids))
        known = _matrix(q["score"], len(ids))
        best = _Best(len(ids), k)
        best.score[:] = known
        best.other[:] = mine = np.frombuffer(q["other"], np.int64).reshape(len(ids), k)
        for r in right.itertuples():
            away = np.sqrt(np.maximum(0, ((x - np.asarray(r.centroid)) ** 2).sum(1))) - r.radius - SLACK
            which = np.flatnonzero(away <= np.sqrt(np.maximum(0, 2 - 2 * np.maximum(best.score[:, -1], -1))))
            if len(which):
                _search(best, x, which, _matrix(r.vectors, r.n), np.frombuffer(r.ids, np.int64))
        return best.rows(ids, mine)

    return run


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def class_neighbours(classes: DataFrame, k: int, block_rows: int = BLOCK_ROWS, chunk_blocks: int | None = None,
                     meeting_blocks: int | None = None, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(cls, vector) of distinct vectors -> (cls, other, score): the ``k`` nearest classes of each, itself among them."""
    n = classes.count()
    chunk_blocks = max(CHUNK_BLOCKS, min(MOST_CHUNK_BLOCKS, n // (block_rows * CHUNKS))) if chunk_blocks is None else chunk_blocks
    meeting_blocks = max(MEETING_BLOCKS, chunk_blocks) if meeting_blocks is None else meeting_blocks
    count = min(MOST_PIVOTS, max(1, n // pivot_rows))
    chosen = classes.orderBy(F.xxhash64("cls"), "cls").limit(count).select("vector").collect()
    if not chosen:
        return classes.sparkSession.createDataFrame([], _TOPS)
    pivots = _unit(np.array([r.vector for r in chosen], np.float64))
    parts = max(1, n // (block_rows * chunk_blocks))
    ordered = classes.mapInPandas(_assign(pivots), "cls long, pivot int, away double, unit binary").repartitionByRange(
        parts, "pivot", "away", "cls").sortWithinPartitions("pivot", "away", "cls")
    blocks = cut(ordered.mapInPandas(_blocks(block_rows, chunk_blocks), _BLOCK), "vector-blocks")
    chunks = cut(blocks.groupBy("chunk").applyInPandas(
        _own(k), "chunk long, ids binary, vectors binary, score binary, other binary, centroids array<array<double>>, radii array<double>, "
        "worst array<double>"), "vector-chunks")
    radii = np.full(len(pivots), -np.inf)
    for r in blocks.groupBy("pivot").agg(F.max("cover").alias("r")).collect():
        radii[r.pivot] = r.r
    sides = chunks.select("chunk", "centroids", "radii", "worst").mapInPandas(
        _pivots_in_reach(pivots, radii + SLACK), "chunk long, pivot int, centre array<double>, reach double")
    summary = blocks.select(F.col("chunk").alias("own"), "block", "pivot", "centroid", "radius")
    pairs = sides.join(summary, "pivot").filter(F.col("chunk") != F.col("own")).filter(
        _distance(F.col("centre"), F.col("centroid")) <= F.col("reach") + F.col("radius")).select("chunk", "block").distinct()
    turns = max(1, blocks.count() // meeting_blocks)
    pairs = cut(pairs.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns))), "vector-pairs")
    asked = chunks.select("chunk", "ids", "vectors", "score", "other").join(pairs.select("chunk", "turn").distinct(), "chunk")
    came = pairs.join(blocks.select("block", "n", "ids", "vectors", "centroid", "radius"), "block").select(
        F.col("chunk").alias("to"), F.col("turn").alias("at"), "n", "ids", "vectors", "centroid", "radius")
    found = asked.groupBy("chunk", "turn").cogroup(came.groupBy("to", "at")).applyInPandas(_others(k), _TOPS)
    own = chunks.select("ids", "score", "other").mapInPandas(_first(k), _TOPS)
    every = own.unionByName(found)
    best = Window.partitionBy("cls").orderBy(F.desc("score"), "other")
    return every.withColumn("_i", F.row_number().over(best)).filter(F.col("_i") <= k).drop("_i")


def _first(k: int):
    def run(batches):
        for pdf in batches:
            for ids, score, other in zip(pdf["ids"], pdf["score"], pdf["other"]):
                ids = np.frombuffer(ids, np.int64)
                best = _Best(len(ids), k)
                best.score, best.other = _matrix(score, len(ids)), np.frombuffer(other, np.int64).reshape(len(ids), k)
                yield best.rows(ids)

    return run


def neighbours(vectors: DataFrame, k: int, **sizes: int) -> DataFrame:
    """(id, vector) -> (id, neighbour, score, rank): the ``k`` most similar other rows by cosine, ties by smaller id.

    Vectors that are null, empty, or hold null or non-finite numbers take no part; a zero vector has cosine 0 with all.
    """
    good = "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(
        "id is not null and vector is not null").filter(good)
    classes = cut(rows.groupBy("vector").agg(F.min("id").alias("cls")), "vector-classes")
    named = cut(rows.join(classes, "vector").select("id", "cls"), "vector-rows")
    near = class_neighbours(classes, k + 1, **sizes)
    # A class needs no more of its rows than a list is long, plus the row that asks.
    member = Window.partitionBy("cls").orderBy("id")
    members = named.distinct().withColumn("_i", F.row_number().over(member)).filter(F.col("_i") <= k + 1).select(
        F.col("cls").alias("other"), F.col("id").alias("neighbour"))
    order = [F.desc("score"), "neighbour"]
    lists = near.join(members, "other").withColumn("_i", F.row_number().over(Window.partitionBy("cls").orderBy(*order))).filter(
        F.col("_i") <= k + 1).select("cls", "neighbour", "score")
    listed = named.join(lists, "cls").filter("id <> neighbour")
    return listed.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(
        F.col("rank") <= k).select("id", "neighbour", "score", "rank")
