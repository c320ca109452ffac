"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Windows of about an item's size slide over the words of a text. The CGK random walk emits the word under its pointer and
then stays or moves on, as a random bit of (step, word) says; windows within a small edit distance emit mostly the same
words at the same steps. A repetition samples some steps of one walk as the key. Windows whose key also occurs in an item
and whose whole embedding is not too far from that window's in Hamming distance are candidates; the edit distance between
the item and the text around the window decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm import wordscan
from tallyforge.llm.packed import fresh
from tallyforge.session import cut

#: Least similarity: one minus the edit distance by the item's length, both in characters of the normalised words.
SIMILARITY = 0.8
#: Walks; the recall of windows with 10 % edited words is measured in the tests.
REPETITIONS = 4
#: Steps of a walk that make a key.
SAMPLED = 3
#: Least share of equal steps in the embeddings of a candidate's two windows, and of the item's words around them.
AGREEMENT = 0.25
#: Words of documents that are embedded together, and windows at a time.
BATCH_WORDS = 200_000
_WINDOWS = 1 << 16
#: Bytes of benchmark text that are searched for in one pass over the documents.
BLOCK_BYTES = 16_000_000

#: Letters, digits and everything beyond ASCII.
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _words(text: str | None):
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    starts, ends = wordscan.spans(data, _IS_WORD)
    return data, starts, ends


def _stride(length: int) -> int:
    return max(1, length // 4)


def _length(n_words: int) -> int:
    """Window length for an item: the largest power of two for which a window of the stride's grid lies inside."""
    length = 1
    while 2 * length + _stride(2 * length) - 1 <= n_words:
        length *= 2
    return length


def walk(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, repetition: int, last: int):
    """The words that the windows from ``starts`` emit at steps 0 to ``last``; 0 beyond their ends."""
    at, end = starts.copy(), np.minimum(starts + length, ends)
    for step in range(last + 1):
        if step % 64 == 0:
            bits = np.append(wordscan.mix(hashes, 1 + repetition * 1009 + step // 64), np.uint64(0))
        inside = at < end
        yield at, inside
        at = at + (((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(bool) & inside)


def walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, repetition: int) -> np.ndarray:
    """The key of the window of ``length`` words, none from ``ends`` on, at each of ``starts``."""
    rng = np.random.default_rng([repetition, length])
    sampled = set(rng.choice(2 * length, min(SAMPLED, 2 * length), replace=False).tolist())
    padded, key = np.append(hashes, np.uint64(0)), np.full(len(starts), length, np.uint64)
    for step, (at, inside) in enumerate(walk(hashes, starts, ends, length, repetition, max(sampled))):
        if step in sampled:
            key = wordscan.mix(key ^ np.where(inside, padded[at], np.uint64(0)), step + 1)
    return key


def agreement(left, right, length: int, repetition: int) -> np.ndarray:
    """Share of equal steps of two embeddings, up to their ends; each side is (hashes, starts, ends)."""
    a, b = np.append(left[0], np.uint64(0)), np.append(right[0], np.uint64(0))
    equal, steps = np.zeros(len(left[1]), np.int64), np.zeros(len(left[1]), np.int64)
    for (i, x), (j, y) in zip(*(walk(*side, length, repetition, 2 * length - 1) for side in (left, right))):
        equal += x & y & (a[i] == b[j])
        steps += x | y
    return equal / steps


def edit_distance_inside(pattern: bytes, text: bytes) -> int:
    """Least edit distance between ``pattern`` and any substring of ``text`` (bit-parallel, one column per byte)."""
    m = len(pattern)
    if not m or pattern in text:
        return 0
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right & top) - bool(left & top)
        best = min(best, score)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return best


class Index:
    """Keys of every window of every item, by window length and repetition."""

    def __init__(self, items: list[tuple], repetitions: int):
        self.items, rows, hashed = [], {}, []
        first = 0
        for item_id, text in items:
            data, starts, ends = _words(text)
            if not len(starts):
                continue
            number, n = len(self.items), len(starts)
            self.items.append((item_id, b" ".join(data[s:e] for s, e in zip(starts, ends)), n, first))
            hashed.append(wordscan.hashes(data, starts, ends))
            length = _length(n)
            offsets = np.arange(n - length + 1)
            for rep in range(repetitions):
                keys = walk_keys(hashed[-1], offsets, np.full(len(offsets), n), length, rep)
                rows.setdefault((length, rep), []).append((keys, np.full(len(keys), number), offsets))
            first += n
        self.hashes = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        self.tables = {}
        for place, parts in rows.items():
            keys, number, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[keys & np.uint64(0xFFFF)] = True
            self.tables[place] = keys[order], number[order], offset[order], seen

    def candidates(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """Item number and the word at which the item would begin; ``begins`` and ``ends`` bound each word's text."""
        found = set()
        place = np.arange(len(hashes)) - begins
        size, firsts = np.array([i[2] for i in self.items]), np.array([i[3] for i in self.items])
        for (length, rep), (keys, number, offset, seen) in self.tables.items():
            grid = np.flatnonzero((place % _stride(length) == 0) & (place <= np.maximum(0, ends - begins - length)))
            for lo in range(0, len(grid), _WINDOWS):
                starts = grid[lo:lo + _WINDOWS]
                own = walk_keys(hashes, starts, ends[starts], length, rep)
                maybe = np.flatnonzero(seen[own & np.uint64(0xFFFF)])
                low, high = np.searchsorted(keys, own[maybe]), np.searchsorted(keys, own[maybe], "right")
                at = np.repeat(starts[maybe], high - low)
                if not len(at):
                    continue
                k = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
                item, shift = number[k], offset[k]
                there = self.hashes, firsts[item] + shift, firsts[item] + size[item]
                near = agreement((hashes, at, ends[at]), there, length, rep) >= AGREEMENT
                found.update(zip(item[near].tolist(), (at - shift)[near].tolist()))
        return found

    def matches(self, texts: list[str | None], similarity: float):
        """(text number, item number, best similarity found) wherever it is at least ``similarity``."""
        words = [_words(t) for t in texts]
        counts = np.array([len(w[1]) for w in words])
        edges = np.concatenate(([0], np.cumsum(counts)))
        if not self.items or not edges[-1]:
            return []
        hashes = np.concatenate([wordscan.hashes(*w) for w in words])
        best, tried = {}, set()
        for number, begin in sorted(self.candidates(hashes, np.repeat(edges[:-1], counts), np.repeat(edges[1:], counts))):
            _, pattern, n, _ = self.items[number]
            slack = n // 4 + 2
            doc = int(np.searchsorted(edges, min(max(begin + n // 2, 0), edges[-1] - 1), "right")) - 1
            begin -= int(edges[doc])
            place = doc, number, begin // slack
            if place in tried or best.get((doc, number)) == 1.0:
                continue
            tried.add(place)
            data, starts, ends = words[doc]
            lo, hi = max(0, (begin // slack - 1) * slack), (begin // slack + 2) * slack + n
            parts = [data[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            own = set(pattern.split(b" "))
            if len(own.intersection(parts)) < AGREEMENT * len(own):
                continue
            around = b" ".join(parts)
            score = 1 - edit_distance_inside(pattern, around) / len(pattern)
            if score >= similarity:
                best[doc, number] = max(score, best.get((doc, number), 0.0))
        return sorted((doc, number, score) for (doc, number), score in best.items())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
                 repetitions: int = REPETITIONS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item id, similarity) for every document and item whose passage it holds; whole texts are searched.

    The items go to the tasks in blocks of about ``block_bytes``, each block in one pass over the documents. Items without
    a word match nothing, null and empty texts hold nothing; equal items are reported each, repeated rows each. An empty
    table on either side gives no rows.
    """
    kinds = {"doc": docs.schema[id_col].dataType.simpleString(), "item": benchmark.schema[item_col].dataType.simpleString()}
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = 1 + int(size // block_bytes)
    # Ids travel as text, which keeps large ones beside nulls.
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def search(block: int) -> DataFrame:
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        index = Index(sorted(rows, key=repr), repetitions)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            known = shared.value
            for pdf in batches:
                size = pdf["text"].map(lambda t: len(t) // 6 if t else 0).cumsum() // BATCH_WORDS
                for _, part in pdf.groupby(size):
                    ids = list(part["id"])
                    out = [(ids[d], known.items[k][0], s) for d, k, s in known.matches(list(part["text"]), similarity)]
                    if out:
                        yield pd.DataFrame(out, columns=["doc", "item", "similarity"])

        found = source.mapInPandas(run, "doc string, item string, similarity double")
        return found.select(F.col("doc").cast(kinds["doc"]).alias(id_col), F.col("item").cast(kinds["item"]).alias(item_col), "similarity")

    out = search(0)
    for block in range(1, blocks):
        out = out.unionByName(search(block))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns, whatever their names.

    Rows count, not ids: of rows with one id, or without, those go whose own text holds a passage; of equal rows all or none.
    No benchmark: all rows stay. No rows: no rows.
    """
    row = fresh("_row", docs.columns)
    marked = cut(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    hit = cut(contaminated(marked, benchmark, row, text_col, **options).select(row).distinct(), "leaks")
    return marked.join(hit, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
