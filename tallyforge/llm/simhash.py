"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Two fingerprints within ``distance`` bits, cut into ``distance + 1`` segments laid on a ring, have a segment from which
every chain of k consecutive segments differs in at most floor(k * distance / segments) = k - 1 bits. Fingerprints are
therefore dealt out by the first two segments of each possible chain: equal in the first, at most one bit apart in the
second. Only a key that many fingerprints share is dealt out again by a longer chain, up to the whole ring. Within a key
the full Hamming distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.components import components
from tallyforge.llm.packed import fresh
from tallyforge.session import cut

SHINGLE = 4
DISTANCE = 4
BITS = 64
#: Rows of one key that are compared in one place; a larger key is split by the next segment of the chain.
GROUP_ROWS = 4096
_SMALL = 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the shingles of ``width`` words, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:][:n]
    set_bits = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory than a block of its shingles
        spans = zip(starts[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row, in the partitions of the input."""
    return docs.select(F.col(id_col).alias("id"), _fingerprint(F.col(text_col), width).alias("fp"))


def _fingerprint(text: Column, width: int) -> Column:
    """Only texts go to the workers, so ids stay what they are."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, width)).astype("int64")

    return of(text)


def _segments(distance: int) -> list[int]:
    """Bit masks of the segments; their widths differ by one at most."""
    edges = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _flips(mask: int, most: int) -> list[tuple[int, int]]:
    """(bits to flip, their number) within a segment, up to ``most`` bits."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [(sum(c), n) for n in range(most + 1) for c in combinations(bits, n)]


def _dealt(distance: int, level: int):
    """Rows (start, key, fp, used) of a chain of ``level`` segments.

    ``used`` counts the flipped bits. Where one flip is the first difference of the chain, only the fingerprint with the
    0 bit flips it, as the other one stays in its own place.
    """
    masks, m = _segments(distance), distance + 1

    def grow(start, fp, key, used):
        segment = masks[(start + level - 1) % m]
        own = fp & np.uint64(segment)
        budget = level * distance // m
        for flip, n in _flips(segment, budget):
            keep = used + n <= budget
            if n == 1:
                keep &= (used > 0) | ((fp & np.uint64(flip)) == 0)
            if keep.any():
                yield start, (key | (own ^ np.uint64(flip)))[keep], fp[keep], used[keep] + n

    def first(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy("int64").view("uint64")
            for start in range(m):
                yield from grow(start, fp, fp & np.uint64(masks[start]), np.zeros(len(fp), np.int64))

    def again(batches):
        for pdf in batches:
            for start, part in pdf.groupby("start"):
                yield from grow(int(start), part["fp"].to_numpy("int64").view("uint64"),
                                part["key"].to_numpy("int64").view("uint64"), part["used"].to_numpy("int64"))

    def frames(rows):
        for start, key, fp, used in rows:
            yield pd.DataFrame({"start": np.full(len(fp), start, np.int32), "key": key.view("int64"),
                                "fp": fp.view("int64"), "used": used.astype("int32")})

    return lambda batches: frames((first if level == 2 else again)(batches))


def spanning(fps: np.ndarray, distance: int):
    """Links (a, b) that join what is within ``distance`` bits, one fewer than the members of each joined set."""
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            found, rest = rest[near], rest[~near]
            queue.extend(found)
            yield from ((at, x) for x in found)


def _compare(distance: int, limit: int, last: bool):
    """Links of the keys of a sorted partition, and the rows of keys beyond ``limit`` as they came (a is null)."""

    def links(rows: pd.DataFrame):
        fp = rows["fp"].to_numpy("int64").view("uint64")
        change = np.flatnonzero((np.diff(rows["key"].to_numpy()) != 0) | (np.diff(rows["start"].to_numpy()) != 0)) + 1
        starts = np.concatenate(([0], change))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        group = np.repeat(np.arange(len(starts)), sizes)
        hit = sizes > _SMALL
        for gap in range(1, _SMALL):  # screens the many small keys at once
            i = np.flatnonzero(group[gap:] == group[:-gap])
            if not len(i):
                break
            near = (np.bitwise_count(fp[i] ^ fp[i + gap]) <= distance) & (fp[i] != fp[i + gap])
            hit[group[i[near]]] = True
        a, b, late = [], [], []
        for g in np.flatnonzero(hit):
            span = slice(starts[g], starts[g] + sizes[g])
            if sizes[g] > limit and not last:
                late.append(rows.iloc[span])
                continue
            for x, y in spanning(fp[span], distance):
                a.append(x)
                b.append(y)
        if a:
            yield pd.DataFrame({"a": np.array(a, "uint64").view("int64"), "b": np.array(b, "uint64").view("int64"),
                                "start": 0, "key": 0, "fp": 0, "used": 0}).astype({"start": "int32", "used": "int32"})
        for part in late:
            yield part.assign(a=None, b=None)[["a", "b", "start", "key", "fp", "used"]].astype({"a": "Int64", "b": "Int64"})

    def run(batches):
        kept = None
        for pdf in batches:  # a key may go on in the next batch
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            tail = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["start"] == pdf["start"].iloc[-1])
            cut_at = int(np.flatnonzero(~tail.to_numpy())[-1]) + 1 if not tail.all() else 0
            if cut_at:
                yield from links(pdf.iloc[:cut_at].reset_index(drop=True))
            kept = pdf.iloc[cut_at:].reset_index(drop=True)
            if len(kept) > limit and not last:  # all of a hot key goes on to the next level, piece by piece
                yield kept.assign(a=None, b=None)[["a", "b", "start", "key", "fp", "used"]].astype({"a": "Int64", "b": "Int64"})
                hot = (kept["start"].iloc[-1], kept["key"].iloc[-1])
                kept = None
                for more in batches:
                    same = ((more["start"] == hot[0]) & (more["key"] == hot[1])).to_numpy()
                    if same.any():
                        yield more[same].assign(a=None, b=None)[["a", "b", "start", "key", "fp", "used"]].astype({"a": "Int64", "b": "Int64"})
                    if not same.all():
                        kept = more[~same].reset_index(drop=True)
                        break
        if kept is not None and len(kept):
            yield from links(kept)

    return run


def links(classes: DataFrame, distance: int = DISTANCE, limit: int = GROUP_ROWS) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) within ``distance`` bits: enough of them to join every set.

    ``distance`` is 1 to 7. Nothing is dropped: a key of more than ``limit`` rows is dealt out by longer chains.
    """
    rows, found = classes.select("fp"), None
    for level in range(2, distance + 2):
        dealt = rows.mapInPandas(_dealt(distance, level), "start int, key long, fp long, used int")
        sorted_keys = dealt.repartition("start", "key").sortWithinPartitions("start", "key")
        out = cut(sorted_keys.mapInPandas(_compare(distance, limit, level == distance + 1),
                                          "a long, b long, start int, key long, fp long, used int"), "ring")
        part = out.filter("a is not null").select("a", "b")
        found = part if found is None else found.union(part)
        rows = out.filter("a is null").select("start", "key", "fp", "used")
        if rows.isEmpty():
            break
    return found


def _components_of(prints: DataFrame, distance: int, limit: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints of ``prints``; linked ones have one root."""
    classes = cut(prints.select("fp").distinct(), "classes")
    label = components(links(classes, distance, limit))
    return classes.join(label, classes["fp"] == label["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    distance: int = DISTANCE, limit: int = GROUP_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words is one
    shingle, one without words (or null) has fingerprint zero and links like any other. ``component_id`` is the smallest
    id that links can reach. Repeated ids give repeated rows; a null id stays null and never names a component unless the
    component has no other. An empty table gives no rows; extra columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width), "prints")
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "first-ids")
    rooted = first.join(_components_of(prints, distance, limit), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, distance: int = DISTANCE,
                limit: int = GROUP_ROWS) -> DataFrame:
    """One row of every component, that of the smallest id; columns as in ``docs``, whatever their names.

    Rows count, not ids: rows of one id with other texts are judged each by its own text, and of equal rows one stays. A null
    id comes after all others. Null texts are a component with texts without words. No rows: no rows.
    """
    row, fp = fresh("_row", docs.columns), fresh("_fp", docs.columns)
    marked = cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, _fingerprint(F.col(f"`{text_col}`"), width)), "marked")
    rooted = _components_of(marked.select(F.col(fp).alias("fp")), distance, limit)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    by_print = marked.select(F.col(fp).alias("fp"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).groupBy("fp").agg(first.alias("first"))
    kept = by_print.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
