"""Exact top-k by inner product with a pivot-distance index.

With one more coordinate that lifts all vectors to the same length, the largest inner products are the smallest Euclidean
distances. Every vector is filed under its nearest pivot by its distance to it; blocks of consecutive vectors are annuli.
A query first searches the two most promising annuli of its own pivot. The k-th distance found bounds the rest: by the
triangle inequality an annulus [low, high] around pivot p can hold a better vector only if d(q, p) - bound <= high and
d(q, p) + bound >= low. Only such annuli are expanded, block against block as matrix products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.session import cut

K = 10
SCALE = 1024
#: Pivots, drawn by hash; vectors of a block, queries of a block, and query blocks that meet a block in one task.
PIVOTS = 64
BLOCK = 1024
QUERIES = 64
MEETING = 64


def scaled(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): floor(SCALE * x) of every component, as doubles; vectors null or with a null or non-finite one are left out."""
    x = F.col(f"`{vec_col}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = df.filter(F.col(f"`{id_col}`").isNotNull() & x.isNotNull()).filter(F.coalesce(finite, F.lit(False)))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "v": [np.floor(SCALE * np.asarray(v, float)) for v in pdf["v"]]})

    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("v")).mapInPandas(
        run, "id long, v array<double>")


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _products(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    if exact:  # every partial sum is an integer below 2^53
        return left @ right.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left], object).reshape(len(left), len(right))


def _filed(rows: DataFrame, pivots: np.ndarray, longest: float, lifted: bool, size: int, name: str) -> DataFrame:
    """(block, pivot, low, high, n, ids, vectors): rows under their nearest pivot in the order of the distance."""
    width = pivots.shape[1]
    up = np.sqrt(np.maximum(longest - (pivots**2).sum(1), 0))

    def near(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            norm = (x**2).sum(1)
            lift = np.sqrt(np.maximum(longest - norm, 0)) if lifted else np.zeros(len(x))
            square = (norm + lift**2)[:, None] + longest - 2 * (x @ pivots.T + lift[:, None] * up[None, :])
            pivot = square.argmin(1)
            distance = np.sqrt(np.maximum(square[np.arange(len(x)), pivot], 0))
            yield pd.DataFrame({"pivot": pivot.astype(np.int32), "d": distance, "id": pdf["id"], "v": list(x)})

    def block(batches):
        number, kept = TaskContext.get().partitionId() << 33, None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            kept, out = None, []
            for pivot, part in pdf.groupby("pivot", sort=True):
                for at in range(0, len(part), size):
                    piece = part.iloc[at:at + size]
                    if piece.index[-1] == len(pdf) - 1 and len(piece) < size:
                        kept = piece  # goes on in the next batch
                        continue
                    out.append(piece)
            for piece in out:
                yield frame(number, piece)
                number += 1
        if kept is not None:
            yield frame(number, kept)

    def frame(number, piece):
        return pd.DataFrame({"block": [number], "pivot": [piece["pivot"].iloc[0]], "low": [piece["d"].min()], "high": [piece["d"].max()],
                             "n": [len(piece)], "ids": [piece["id"].to_numpy(np.int64).tobytes()],
                             "vectors": [np.stack(piece["v"].to_list()).tobytes()]})

    sorted_rows = rows.mapInPandas(near, "pivot int, d double, id long, v array<double>").repartitionByRange(
        "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return cut(sorted_rows.mapInPandas(block, "block long, pivot int, low double, high double, n long, ids binary, vectors binary"), name)


def _search(pairs: DataFrame, index: DataFrame, queries: DataFrame, width: int, k: int, exact: bool) -> DataFrame:
    """(q_block, place, query_id, vec_id, score): the k best of every annulus for every query of a pair, if at least the floor so far.

    A query is known by its block and its place there, so that two queries of one id have lists of their own.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for ids, vectors, met in zip(pdf["ids"], pdf["vectors"], pdf["met"]):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, width)
                for m in met:
                    q_ids, q = np.frombuffer(m["q_ids"], np.int64), np.frombuffer(m["q_vectors"]).reshape(-1, width)
                    floors = np.frombuffer(m["floors"]) if m["floors"] else np.full(len(q_ids), -math.inf)
                    scores = _products(q, x, exact)
                    for place, (q_id, row, floor) in enumerate(zip(q_ids.tolist(), scores, floors.tolist())):
                        at = np.flatnonzero((ids != q_id) & (row >= floor))
                        if len(at) > k and not exact:  # whole numbers beyond what doubles hold
                            at = np.array(sorted(at.tolist(), key=lambda i: (-row[i], ids[i]))[:k])
                        elif len(at) > k:
                            kth = np.partition(row[at].astype(float), len(at) - k)[len(at) - k]
                            at = at[row[at] >= kth]
                            at = at[np.lexsort((ids[at], -row[at].astype(float)))][:k]
                        out += [(m["q_block"], place, q_id, i, int(s)) for i, s in zip(ids[at].tolist(), row[at].tolist())]
            if out:
                yield pd.DataFrame(out, columns=["q_block", "place", "query_id", "vec_id", "score"])

    order = Window.partitionBy("block").orderBy(F.xxhash64("q_block"), "q_block")  # the pairs are distinct; the hash only deals out turns
    met = pairs.withColumn("turn", F.floor((F.row_number().over(order) - 1) / MEETING)).join(queries, "q_block")
    met = met.groupBy("block", "turn").agg(F.collect_list(F.struct("q_block", "q_ids", "q_vectors", "floors")).alias("met"))
    return met.join(index.select("block", "ids", "vectors"), "block").select("ids", "vectors", "met").mapInPandas(
        run, "q_block long, place int, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the largest integer inner product, ties to the smaller id.

    Candidates with the query's own id do not count. Equal query rows are one query; queries of one id and other vectors have a
    list each. Equal candidate rows are listed each. Null ids, null vectors and vectors with null or non-finite components
    take no part; shorter vectors count as filled with zeros. Fewer candidates give fewer rows, no candidates none.
    """
    rows, asked = cut(scaled(vectors, id_col, vec_col), "vectors"), cut(scaled(queries, id_col, vec_col).dropDuplicates(["id", "v"]), "asked")
    both = rows.select("v").unionByName(asked.select("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    width, longest = both.agg(F.max(F.size("v")), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not width or rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    exact = longest < 2**53
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    corner = _matrix([r["v"] for r in chosen], width)
    index = _filed(rows, corner, longest, True, BLOCK, "index")
    asked = _filed(asked, corner, longest, False, QUERIES, "queries")
    queries = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    rings = index.select("block", "pivot", "low", "high")
    up = np.sqrt(np.maximum(longest - (corner**2).sum(1), 0))

    own = asked.select(F.col("block").alias("q_block"), "pivot", F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"))
    first = own.join(rings, "pivot").withColumn(
        "turn", F.row_number().over(Window.partitionBy("q_block").orderBy(gap, F.desc("high"), "block"))).filter("turn <= 2")
    start = queries.withColumn("floors", F.lit(None).cast("binary"))
    found = _best(_search(first.select("q_block", "block"), index, start, width, k, exact), k)
    floors = cut(found.groupBy("q_block", "place").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")), "floors")

    def bounded(batches):
        for pdf in batches:
            out = []
            for q_block, ids, vectors, known in zip(pdf["q_block"], pdf["q_ids"], pdf["q_vectors"], pdf["known"]):
                ids, q = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, width)
                at = {m["place"]: m["floor"] for m in known if m["floor"] is not None} if known is not None else {}
                floor = np.array([at.get(i, -math.inf) for i in range(len(ids))], float)
                if not exact:
                    floor = np.nextafter(floor, -math.inf)
                square = (q**2).sum(1) + longest
                bound = np.sqrt(np.maximum(square - 2 * floor, 0)) * (1 + 1e-9) + 1e-3
                to = np.sqrt(np.maximum(square[:, None] - 2 * (q @ corner.T), 0))
                for p in range(len(corner)):
                    out.append((q_block, p, float((to[:, p] - bound).min()), float((to[:, p] + bound).max()), floor.tobytes()))
            yield pd.DataFrame(out, columns=["q_block", "pivot", "from", "upto", "floors"])

    known = floors.groupBy("q_block").agg(F.collect_list(F.struct("place", "floor")).alias("known"))
    spread = cut(queries.join(known, "q_block", "left").mapInPandas(
        bounded, "q_block long, pivot int, `from` double, upto double, floors binary"), "bounds")
    pairs = spread.join(rings, (spread["pivot"] == rings["pivot"]) & (rings["high"] >= spread["from"]) & (rings["low"] <= spread["upto"]))
    ready = queries.join(spread.groupBy("q_block").agg(F.first("floors").alias("floors")), "q_block")
    out = _best(_search(pairs.select("q_block", "block"), index, ready, width, k, exact), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
