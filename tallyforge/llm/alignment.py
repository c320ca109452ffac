"""Two tokenizers aligned over the same bytes.

Every text is encoded whole by both. Ends that both share and behind which both next tokens begin with a space are anchors;
they split a document into windows of token ids. A window's alignment depends on its ids alone, so a block works it out once
for each distinct pair of id tuples, whatever the number of its windows. Inside a window the bytes at which both end close the groups, and tokens whose byte
ranges overlap are linked.

Documents are stored in blocks that know their windows and the distinct id pairs of those. The pairs of all blocks are
counted by a shuffle (a pair at most once for each block), and every block gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm import packing, wordscan
from tallyforge.llm.packed import narrow, pack, unpack
from tallyforge.session import cut

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000
_SHIFT = 1 << 32
#: Ids up to which windows are told apart by whole-array operations.
_LANES = 8
_pairs: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str):
        import os

        import public_tokenizers
        import sentencepiece

        self.a = packing.encoder(byte_tokenizer)
        path = piece_tokenizer if os.path.isabs(piece_tokenizer) else public_tokenizers.path(piece_tokenizer)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path)
        size = max(self.a.tokenizer.get_vocab().values()) + 1
        self.a_bytes = [b""] * size
        for token in self.a.fast.token_byte_values():
            self.a_bytes[self.a.fast.encode_single_token(token)] = token
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_len), len(self.b_len))
        self.written = np.array([[f"{i}{sign}" for i in range(most)] for sign in (",", "|", ";", "")], object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of every text by both; none where the tokens do not spell a space and the text."""
        a_bytes, b_bytes, none = self.a_bytes.__getitem__, self.b_bytes.__getitem__, []
        a_ids, b_ids = [], self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            spaced = " " + text
            words = text.split()
            # Very long runs go the slow way; see the encoder.
            longest = max(map(len, words), default=0)
            slow = longest >= 1000 or len(text) - sum(map(len, words)) - len(words) >= 900
            a = (np.frombuffer(self.a.one(spaced), "<u4").tolist() if slow else self.a.fast.encode_ordinary(spaced)) if text else none
            whole = spaced.encode()
            if not a or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b_ids[i])) != whole:
                a = b_ids[i] = none
            a_ids.append(a)
        return a_ids, b_ids

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Of documents one after another: the last byte of each window, which distinct window it is, and the ids of those.

        Every document begins with a space in both, so that its end is an anchor like others. The distinct windows are
        numbered by their pair of id tuples; of each, the ids of both sides are given one after another, with their numbers.
        """
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_last, b_last = a_end[np.append(self.a_space[a[1:]], True)], b_end[np.append(self.b_space[b[1:]], True)]
        anchors = a_last[b_last[np.minimum(np.searchsorted(b_last, a_last), len(b_last) - 1)] == a_last]
        a_cut, b_cut = np.searchsorted(a_end, anchors) + 1, np.searchsorted(b_end, anchors) + 1
        a_from, b_from = np.append(0, a_cut[:-1]), np.append(0, b_cut[:-1])
        short = (a_cut - a_from <= _LANES) & (b_cut - b_from <= _LANES)
        place = np.empty(len(anchors), np.int64)
        same, place[short] = _distinct(np.concatenate((_lanes(a, a_from[short], a_cut[short]), _lanes(b, b_from[short], b_cut[short])), 1))
        first = np.flatnonzero(short)[same].tolist()
        known: dict[tuple, int] = {}
        for w in np.flatnonzero(~short).tolist():
            key = tuple(a[a_from[w]:a_cut[w]].tolist()), tuple(b[b_from[w]:b_cut[w]].tolist())
            place[w] = known.setdefault(key, len(same) + len(known))
            if place[w] == len(first):
                first.append(w)
        first = np.array(first, np.int64)
        return anchors, place, (*_runs(a, a_from[first], a_cut[first]), *_runs(b, b_from[first], b_cut[first]))

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of every window the groups as text and their number, the number of links, and all links as ``a * 2**32 + b``.

        All windows at once, their bytes one after another: a link is a stretch of bytes between two ends of either side.
        """
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = _sorted_distinct(np.concatenate((a_end, b_end)))
        link = a[np.searchsorted(a_end, ends)].astype(np.int64) * _SHIFT + b[np.searchsorted(b_end, ends)]
        common = a_end[b_end[np.searchsorted(b_end, a_end)] == a_end]
        # The text has each group's ids of A, then those of B; the last of each and of the window have signs of their own.
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_upto, b_upto = (np.searchsorted(g, np.arange(len(common)), "right") for g in (a_group, b_group))
        a_place = np.arange(len(a)) + np.append(0, b_upto)[a_group]
        b_place = np.arange(len(b)) + a_upto[b_group]
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_upto - 1], b_sign[b_upto - 1], b_sign[np.cumsum(n_b) - 1] = 1, 2, 3
        signs = np.empty(len(a) + len(b), object)
        signs[a_place], signs[b_place] = self.written[a_sign, a], self.written[b_sign, b]
        signs = signs.tolist()
        window_end = a_end[np.cumsum(n_a) - 1]
        upto = np.cumsum(n_a + n_b).tolist()
        texts = ["".join(signs[s:e]) for s, e in zip([0] + upto, upto)]
        return texts, np.diff(np.searchsorted(common, window_end, "right"), prepend=0), np.diff(np.searchsorted(ends, window_end, "right"), prepend=0), link


def _runs(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = end - begin
    return ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size


def _lanes(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ids of each run, filled up to a fixed number with what is no id."""
    rows = np.lib.stride_tricks.sliding_window_view(np.append(ids, np.zeros(_LANES, ids.dtype)), _LANES)[begin]
    rows[np.arange(_LANES) >= (end - begin)[:, None]] = -1
    return rows


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row, and for every row which one it is."""
    h = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(rows).view(np.uint64).T:
        h = wordscan.mix(h ^ column)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not (rows[first][place] == rows).all():  # two rows with one hash
        _, first, place = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, place.reshape(-1)


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def pair(byte_tokenizer: str, piece_tokenizer: str) -> Pair:
    key = byte_tokenizer, piece_tokenizer
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


def _block(both: Pair, number: int, ids: list, texts: list[str], keep: bool) -> pd.DataFrame:
    """(block, data, pairs, documents): documents and windows, the distinct id pairs and how many documents hold each."""
    encoded = both.encode(texts)
    n_a, n_b = (np.array([len(x) for x in e], np.int64) for e in encoded)
    a, b = (np.fromiter(chain.from_iterable(e), np.int32, int(n.sum())) for e, n in zip(encoded, (n_a, n_b)))
    anchors = place = per_window = width = links = np.zeros(0, np.int64)
    fragments: list[str] = []
    if len(a):
        anchors, place, distinct = both.windows(a, b)
        fragments, per_window, width, links = both.align(*distinct)
    # Which document a window is of, by where the documents end.
    ends = np.append(0, np.cumsum(both.a_len[a]))[np.cumsum(n_a)]
    first = np.searchsorted(anchors, np.append(0, ends[:-1]), "right")
    upto = np.searchsorted(anchors, ends, "right")
    sizes = upto - first
    of_window = place.tolist()
    groups = np.append(0, np.cumsum(per_window[place]))
    rows = []
    for i, doc in enumerate(ids):
        text = ";".join([fragments[p] for p in of_window[first[i]:upto[i]]])
        digest = hashlib.sha256(text.encode()).hexdigest() if sizes[i] else ""
        rows.append((doc, int(n_a[i]), int(n_b[i]), int(groups[upto[i]] - groups[first[i]]), digest) + ((text,) if keep else ()))
    key, link = np.unique(links, return_inverse=True)
    # Each document's distinct windows, then their links, then its distinct pairs.
    doc, own = np.divmod(_sorted_distinct(np.repeat(np.arange(len(rows)), sizes) * max(1, len(width)) + place), max(1, len(width)))
    begin = np.append(0, np.cumsum(width))[own]
    inside = np.arange(int(width[own].sum())) - np.repeat(np.cumsum(width[own]) - width[own], width[own])
    in_doc = _sorted_distinct(np.repeat(doc, width[own]) * max(1, len(key)) + link[np.repeat(begin, width[own]) + inside])
    documents = np.bincount(in_doc % max(1, len(key)), minlength=len(key))
    data = pack((rows, sizes, narrow(place), narrow(width), narrow(link)))
    return pd.DataFrame({"block": [number], "data": [data], "pairs": [key], "documents": [documents]})


def _blocks(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, block_bytes: int, keep: bool) -> DataFrame:
    def run(batches):
        both = pair(byte_tokenizer, piece_tokenizer)
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"]):
                text = text or ""
                if ids and size + len(text) > block_bytes:
                    yield _block(both, number, ids, texts, keep)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 16
        if ids:
            yield _block(both, number, ids, texts, keep)

    return docs.mapInPandas(run, "block long, data binary, pairs array<long>, documents array<long>")


def _summed(keep: bool):
    def run(key, block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.sort_values("place")
        count, best = answers["n"].to_numpy(np.int64), answers["best"].to_numpy(bool)
        for data in block["data"]:
            rows, sizes, numbers, width, link = unpack(data)
            at = np.concatenate(([0], np.cumsum(width.astype(np.int64))))
            per_link = np.stack((np.ones(len(link), np.int64), best[link].astype(np.int64), count[link])) if len(link) else np.zeros((3, 0), np.int64)
            sums = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(per_link, axis=1)), axis=1)
            by_window = (sums[:, at[1:]] - sums[:, at[:-1]])[:, numbers]
            sums = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(by_window, axis=1)), axis=1)
            end = np.cumsum(sizes)
            of_doc = (sums[:, end] - sums[:, end - sizes]).T.tolist()
            out += [(r[0], *r[1:4], *s, *r[4:]) for r, s in zip(rows, of_doc)]
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * keep
        return pd.DataFrame(out, columns=names)

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_tokenizer: str = BYTE_TOKENIZER,
          piece_tokenizer: str = PIECE_TOKENIZER, block_bytes: int = BLOCK_BYTES, keep_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for every row.

    Tokens are those of a space and the text. A text that is null, empty, or not spelt by both tokenizers has none: zeros
    and an empty digest. Repeated rows are documents of their own and count each; ids may be null or repeat; columns beside
    id and text play no part. No rows: no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    blocks = cut(_blocks(plain, byte_tokenizer, piece_tokenizer, block_bytes, keep_groups), "aligned")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select(
        "block", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    counts = held.groupBy("pair").agg(F.sum("documents").alias("n"))
    # At most as many pairs share an A id as the other vocabulary has ids.
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = cut(counts.select("pair", "n", (F.col("n") == top).alias("best")), "pair-counts")
    answers = held.select("block", "place", "pair").join(counts, "pair").select(
        F.col("block").alias("of_block"), "place", "n", "best")
    out = blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(
        _summed(keep_groups), "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string" + ", groups string" * keep_groups)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
