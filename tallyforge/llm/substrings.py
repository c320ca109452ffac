"""Repeated word windows removed, found by super-k-mers.

Texts are stored in blocks of normalised words. Consecutive windows with the same minimiser (the least hash of the
``GRAM``-word grams inside) travel as one packed string to the minimiser's bucket; a window's words decide its minimiser, so
equal windows meet. A task gathers the strings of several blocks and sends equal ones once, with their places, so a passage
that everyone shares reaches its bucket a few times per task, and the parts of a bucket stay long enough to compress. The bucket sorts the windows by hash, compares equal hashes by their words, and answers each block
which windows of which strings are repeated; the block then marks and removes the covered words.

A minimiser with very many strings (a line that many documents hold in different surroundings) would fill one bucket. Such
minimisers are found first, from a sample of the strings; their windows travel each by a 128-bit BLAKE2b digest of its words
to a bucket of that digest, so that no bucket depends on how often a minimiser occurs. Equal digests count as equal words.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm import wordscan
from tallyforge.session import cut

WINDOW = 35
#: Words of a minimiser's gram.
GRAM = 8
#: Bytes of text in a block (a longer text is a block of its own), and about the bytes of input per bucket.
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 8_000_000
#: Bytes of strings that a task gathers before it sends them, and the bytes each string and place counts besides its text.
SEND_BYTES = 64_000_000
STRING_COST = 150
#: A minimiser with about that many strings is hot; its windows are dealt out by their digests.
HOT_RUNS = 40_000
#: Bytes of a digest, and about the bytes that the windows of one hot string take.
DIGEST = 16
_HOT_COST = 1200
#: Windows of one string at most.
_RUN = 64
_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


def _pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int, step: int) -> DataFrame:
    """(block, bytes, data, sample): ids and normalised texts of some rows, and the minimisers of one string in ``step``."""

    def frame(number, ids, texts, size):
        runs = Runs(texts, window)
        taken = wordscan.mix(runs.firsts.astype(np.uint64) + np.uint64(number), 5) % np.uint64(step) == 0
        return pd.DataFrame({"block": [number], "bytes": [size], "data": [_pack((ids, texts))], "sample": [runs.minimiser[taken].tobytes()]})

    def run(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"]):
                norm = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
                if ids and size + len(norm) > block_bytes:
                    yield frame(number, ids, texts, size)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(norm)
                size += len(norm)
        if ids:
            yield frame(number, ids, texts, size)

    # Ids travel as text, which keeps large ones beside nulls.
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "block long, bytes long, data binary, sample binary")


def _hot(blocks: DataFrame, hot_runs: int, step: int) -> tuple[np.ndarray, int]:
    """The minimisers of about ``hot_runs`` strings and more, in order, and about the number of their strings."""

    def run(batches):
        for pdf in batches:
            value, times = np.unique(np.frombuffer(b"".join(pdf["sample"]), np.int64), return_counts=True)
            yield pd.DataFrame({"minimiser": value, "times": times})

    counts = blocks.select("sample").mapInPandas(run, "minimiser long, times long").groupBy("minimiser").agg(F.sum("times").alias("times"))
    found = counts.filter(F.col("times") * step >= hot_runs).collect()
    return np.sort(np.array([r["minimiser"] for r in found], np.int64).view(np.uint64)), sum(r["times"] for r in found) * step


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


class Runs:
    """The packed strings of a block: words, and runs of windows with one minimiser."""

    def __init__(self, texts: list[bytes], window: int):
        full = [t for t in texts if t]
        self.data = b" ".join(full)
        self.starts, self.ends = wordscan.spans(self.data, _IS_WORD)
        self.firsts = first = last = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, np.uint64)
        n = len(self.starts)
        if n >= window:
            doc = np.repeat(np.arange(len(full)), [t.count(b" ") + 1 for t in full])
            gram = min(GRAM, window)
            hashes = wordscan.hashes(self.data, self.starts, self.ends)
            least = _sliding_min(wordscan.windows(hashes, gram), window - gram + 1)
            valid = np.flatnonzero(doc[window - 1:] == doc[:n - window + 1])
            if len(valid):
                value = least[valid]
                new = np.concatenate(([True], (np.diff(valid) != 1) | (value[1:] != value[:-1])))
                begin = np.maximum.accumulate(np.where(new, np.arange(len(valid)), 0))
                new |= (np.arange(len(valid)) - begin) % _RUN == 0
                at = np.flatnonzero(new)
                first, last = valid[at], valid[np.concatenate((at[1:], [len(valid)])) - 1]
                self.minimiser = value[at]
        self.firsts, self.lasts, self.window = first, last, window

    def strings(self):
        """(first window, packed string) of every run."""
        begin, end = self.starts[self.firsts], self.ends[self.lasts + self.window - 1] if len(self.firsts) else []
        for first, s, e in zip(self.firsts.tolist(), np.asarray(begin).tolist(), np.asarray(end).tolist()):
            yield first, self.data[s:e]

    def hot(self, minimisers: np.ndarray) -> list[int]:
        """For every run the number of its windows if its minimiser is among ``minimisers``, else 0."""
        return np.where(np.isin(self.minimiser, minimisers), self.lasts - self.firsts + 1, 0).tolist()

    def digests(self, first: int, number: int) -> list[bytes]:
        begin, end = self.starts[first:first + number].tolist(), self.ends[first + self.window - 1:first + number + self.window - 1].tolist()
        return [hashlib.blake2b(self.data[s:e], digest_size=DIGEST).digest() for s, e in zip(begin, end)]


def _send(window: int, buckets: int, hot: np.ndarray, hot_buckets: int):
    """(bucket, data): strings and their places; buckets below 0 get the digests of hot windows."""

    def rows(parts: dict[int, dict[bytes, list[int]]]) -> pd.DataFrame:
        out = []
        for b, found in parts.items():
            places = list(found.values())
            sizes = np.array([len(x) // 3 for x in places], np.int64)
            keys = (b"\n" if b >= 0 else b"").join(found)
            out.append((b, _pack((keys, sizes, np.array([v for x in places for v in x], np.int64).reshape(-1, 3)))))
        return pd.DataFrame(out, columns=["bucket", "data"])

    def add(found: dict[bytes, list[int]], key: bytes, block: int, first: int) -> int:
        seen = found.get(key)
        if seen is None:
            found[key] = [block, first, 1]
            return len(key) + STRING_COST
        if seen[-3] == block:
            seen[-1] += 1
            return 0
        seen += [block, first, 1]
        return STRING_COST

    def run(batches):
        parts: dict[int, dict[bytes, list[int]]] = {}
        held = 0
        for pdf in batches:
            for block, data in zip(pdf["block"].tolist(), pdf["data"]):
                runs = Runs(_unpack(data)[1], window)
                if not len(runs.firsts):
                    continue
                bucket = (wordscan.mix(runs.minimiser, 77) % np.uint64(buckets)).astype(np.int64).tolist()
                for (first, string), b, number in zip(runs.strings(), bucket, runs.hot(hot)):
                    if not number:
                        held += add(parts.setdefault(b, {}), string, block, first)
                        continue
                    for digest in runs.digests(first, number):
                        b = -1 - int.from_bytes(digest[:8], "little") % hot_buckets
                        held += add(parts.setdefault(b, {}), digest, block, 0)
                if held > SEND_BYTES:
                    yield rows(parts)
                    parts, held = {}, 0
        if parts:
            yield rows(parts)

    return run


def _count_digests(parts: list) -> pd.DataFrame:
    """Answers (block, data): the repeated digests of every block."""
    keys = b"".join(p[0] for p in parts)
    halves = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    sizes = np.concatenate([p[1] for p in parts])
    places = np.concatenate([p[2] for p in parts])
    total = np.add.reduceat(places[:, 2], np.cumsum(sizes) - sizes)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    begins = np.flatnonzero(np.concatenate(([True], (halves[order][1:] != halves[order][:-1]).any(1))))
    repeated = np.zeros(len(order), bool)
    repeated[order] = np.repeat(np.add.reduceat(total[order], begins) > 1, np.diff(np.concatenate((begins, [len(order)]))))
    of = np.repeat(np.arange(len(sizes)), sizes)
    taken = np.flatnonzero(repeated[of])
    taken = taken[np.argsort(places[taken, 0], kind="stable")]
    blocks, at = np.unique(places[taken, 0], return_index=True)
    return pd.DataFrame([(b, _pack([(keys[DIGEST * k:DIGEST * k + DIGEST], None) for k in of[mine].tolist()]))
                         for b, mine in zip(blocks.tolist(), np.split(taken, at[1:]))], columns=["block", "answer"])


def _count(window: int):
    """Answers (block, data): for strings with repeated windows their first window in the block and a flag per window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d) for d in pdf["data"]]
        if pdf["bucket"].iloc[0] < 0:
            return _count_digests(parts)
        data = b"\n".join(p[0] for p in parts)
        upto = np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parts]))))
        places = np.concatenate([p[2] for p in parts])  # block, first window and number, for each string in turn
        total = np.add.reduceat(places[:, 2], upto[:-1])
        del parts
        starts, ends = wordscan.spans(data, _IS_WORD)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        string = np.searchsorted(breaks, starts)
        hashes = wordscan.windows(wordscan.hashes(data, starts, ends), window)
        valid = np.flatnonzero(string[window - 1:] == string[:len(starts) - window + 1])
        order = valid[np.argsort(hashes[valid], kind="stable")]
        same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1], [False]))
        begins = np.flatnonzero(~same[:-1])
        times = np.add.reduceat(total[string[order]], begins) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((begins, [len(order)])))
        repeated = np.zeros(len(starts), bool)
        words = lambda w: data[starts[w]:ends[w + window - 1]]
        for g in np.flatnonzero(times > 1).tolist():
            members = order[begins[g]:begins[g] + sizes[g]]
            one = words(members[0])
            if all(words(w) == one for w in members[1:].tolist()):
                repeated[members] = True
                continue
            count: dict[bytes, int] = {}  # different windows with one hash
            for w in members.tolist():
                count[words(w)] = count.get(words(w), 0) + int(total[string[w]])
            for w in members.tolist():
                repeated[w] = count[words(w)] > 1
        flagged = np.unique(string[repeated])
        answers: dict[int, list] = {}
        first_word = np.searchsorted(string, np.arange(len(total) + 1))
        for s in flagged.tolist():
            bits = np.packbits(repeated[first_word[s]:first_word[s + 1] - window + 1]).tobytes()
            for block, first, _ in places[upto[s]:upto[s + 1]].tolist():
                answers.setdefault(block, []).append((first, bits))
        return pd.DataFrame([(b, _pack(a)) for b, a in answers.items()], columns=["block", "answer"])

    return run


def _remove(window: int, kind, hot: np.ndarray):
    def run(batches):
        for pdf in batches:
            for data, answers in zip(pdf["data"], pdf["answers"]):
                ids, texts = _unpack(data)
                flags = dict(a for part in (answers if answers is not None else ()) for a in _unpack(part))
                runs = Runs(texts, window)
                change = np.zeros(len(runs.starts) + 1, np.int64)
                if flags:
                    by_string: dict[bytes, bytes | None] = {}
                    for (first, string), number in zip(runs.strings(), runs.hot(hot)):
                        if number:
                            hit = first + np.flatnonzero([d in flags for d in runs.digests(first, number)])
                            change[hit] += 1
                            change[hit + window] -= 1
                            continue
                        bits = by_string.setdefault(string, flags.get(first))
                        if bits is not None:
                            hit = first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                            change[hit] += 1
                            change[hit + window] -= 1
                covered = np.cumsum(change[:-1]) > 0
                out, at = [], 0
                for doc, text in zip(ids, texts):
                    n = text.count(b" ") + 1 if text else 0
                    gone = covered[at:at + n]
                    at += n
                    if gone.any():
                        text = b" ".join([w for w, g in zip(text.split(b" "), gone.tolist()) if not g])
                    out.append((doc, n, int(gone.sum()), text))
                frame = pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])
                frame["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in frame["kept"]]
                frame["kept"] = [t.decode("utf-8", "surrogatepass") for t in frame["kept"]] if kind else None
                yield frame if kind else frame.drop(columns="kept")

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   keep_text: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) for every row.

    Every word that a repeated window of ``window`` words covers goes; windows are judged on the input, and a window that
    repeats within one document is repeated too. Words are runs of anything but ASCII white space; null texts have none.
    Texts shorter than a window lose nothing; equal rows lose all that windows cover. No rows: no rows.
    """
    step = max(1, min(256, HOT_RUNS // 100))
    blocks = cut(_blocks(docs, id_col, text_col, block_bytes, window, step), "blocks")
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = 8 + int(total // bucket_bytes)
    hot, runs = _hot(blocks, HOT_RUNS, step)
    hot_buckets = 1 + int(runs * _HOT_COST // bucket_bytes)
    sent = blocks.select("block", "data").mapInPandas(_send(window, buckets, hot, hot_buckets), "bucket long, data binary")
    answers = sent.groupBy("bucket").applyInPandas(_count(window), "block long, answer binary")
    by_block = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))
    joined = blocks.select("block", "data").join(by_block, "block", "left").select("data", "answers")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInPandas(_remove(window, keep_text, hot), "id string, n_words long, n_removed long" + ", kept string" * keep_text
                             + ", kept_sha256 string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
