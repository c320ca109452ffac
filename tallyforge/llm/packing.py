"""Best-fit packing by exact complements.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. For a length, the gap it
leaves is looked up among single lengths, then among sums of two and of three lengths that are still available; as many
sequences as the counts allow are made of such a combination at once. What has no exact complement goes best-fit into
the remaining gaps. Pieces are then dealt to the planned places by their rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.session import cut

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length that one window ranks, roughly.
RANKED_ROWS = 100_000
_LONG_RUN = re.compile(r"(?<!\S)\S{1000}|(?<!\s)\s{1000}")
# Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary file, its ids and its splitting are those of `tokenizers`; as the ids of this byte-level vocabulary are
    also the order of its merges, `tiktoken` gives the same ids from them at several times the speed. Texts with very long
    runs, on which its matching is slow, go to `tokenizers` itself. The tests hold the two against each other.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {bytes(_BYTE[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: By id, whether it begins with a space.
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def one(self, text: str) -> bytes:
        slow = len(text) >= 1000 and _LONG_RUN.search(text)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def cut_ids(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]); a null text has only the end id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):  # ids travel as text, which keeps large ones beside nulls
        codes, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                ids = memoryview(codes.one(text or "") + end)
                for i, (start, length) in enumerate(cut_ids(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    row = (doc, i, start, length, zlib.crc32(part))
                    out.append(row + (np.frombuffer(part, "<u4").astype("int32"),) if keep_ids else row)
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", "ids"][:5 + keep_ids])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, "id string, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * keep_ids).withColumn(
        "id", F.col("id").cast(kind))


def _pair(free: np.ndarray, total: int, top: int) -> tuple[int, tuple[int, int]]:
    """How often, and by which two lengths up to ``top``, ``total`` can be made at most."""
    a = np.arange((total + 1) // 2, min(total - 1, top) + 1)
    if not len(a):
        return 0, (0, 0)
    times = np.minimum(free[a], free[total - a])
    times[a == total - a] //= 2
    best = int(times.argmax())
    return int(times[best]), (int(a[best]), total - int(a[best]))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences); ``counts[l]`` pieces have length l.

    Taking every complement at once can use up short pieces that would fill more gaps one by one, so the plans with
    complements of up to three, two, one and no pieces are compared and the one of fewest sequences is taken.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda made: sum(n for _, n in made))


def _plan(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    free = np.array(counts, np.int64)
    made: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> bool:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((free[used] // need[used]).min())
        if times:
            free[used] -= times * need[used]
            made.append((lengths, times))
        return times > 0

    def complete(length: int, parts: int) -> bool:
        """One or more sequences of ``length`` and that many other pieces, exactly full."""
        gap = capacity - length
        if not free[length] or gap < parts:
            return False
        if parts == 1:
            return take(length, gap)
        free[length] -= 1
        rest: tuple[int, ...] = ()
        if parts == 2:
            times, two = _pair(free, gap, gap)
            rest = two if times else ()
        else:
            for a in np.flatnonzero(free[:gap - 1])[::-1].tolist():
                if 3 * a < gap:
                    break
                free[a] -= 1
                times, two = _pair(free, gap - a, a)
                free[a] += 1
                if times:
                    rest = (a, *two)
                    break
        free[length] += 1
        return bool(rest) and take(length, *rest)

    take(capacity)
    for parts in range(1, most + 1):  # pieces beyond the half come first: no two of them share a sequence
        for length in range(capacity - 1, capacity // 2, -1):
            while complete(length, parts):
                pass
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        while free[length]:
            room = min((r for r in gaps if r >= length), default=None)
            if room is None:
                if any(complete(length, parts) for parts in range(1, most + 1)):
                    continue
                each = capacity // length
                times, rest = divmod(int(free[length]), each)
                for k, n in ((each, times), (rest, 1)):
                    if k and n:
                        gaps.setdefault(capacity - k * length, []).append(((length,) * k, n))
                free[length] = 0
                continue
            held, n = gaps[room].pop()
            times = min(n, int(free[length]))
            if n > times:
                gaps[room].append((held, n - times))
            if not gaps[room]:
                del gaps[room]
            gaps.setdefault(room - length, []).append((held + (length,), times))
            free[length] -= times
    return made + [x for r in sorted(gaps) for x in gaps[r]]


def places(planned: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY):
    """For each length: the ranks at which a new place begins, and that place's first sequence and offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    filled, first = np.zeros(capacity + 1, np.int64), 0
    for lengths, times in planned:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((int(filled[length]), first, offset))
            filled[length] += times
            offset += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """A row for every piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    Every document is one piece, or if longer than ``capacity`` full pieces after a first one. Null texts count as empty:
    one piece of the end id. Repeated rows are packed each; the order of equal rows is any. No documents: no rows.
    """
    cuts = cut(pieces(docs, id_col, text_col, capacity, tokenizer, keep_ids), "pieces")
    groups = max(1, cuts.count() // RANKED_ROWS)
    dealt = cuts.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(16 * groups)))
    dealt = cut(dealt, "dealt")
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    table = places(plan(counts, capacity), capacity)
    ranked = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(sizes.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches):
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, at in pdf.groupby("length").indices.items():
                begins, first, offsets = table[length]
                rank = pdf["rank"].to_numpy()[at]
                i = np.searchsorted(begins, rank, "right") - 1
                sequence[at], offset[at] = first[i] + rank - begins[i], offsets[i]
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    kind, schema = cuts.schema["id"].dataType.simpleString(), schema.replace(f"id {cuts.schema['id'].dataType.simpleString()}", "id string", 1)
    out = ranked.select(*kept, "rank").withColumn("id", F.col("id").cast("string")).mapInPandas(
        place, schema + ", sequence_id long, offset long").withColumn("id", F.col("id").cast(kind))
    return out.withColumn("length", F.col("length").cast("long")).withColumnRenamed("id", id_col)
