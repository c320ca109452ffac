"""Phrase mining over occurrence relations, length by length.

The relation of length k says which frequent phrase of k words begins at each place of each piece. It is stored in blocks
of documents of one language, in the order of the pieces. A round joins the relation with itself at adjacent places, which
gives the occurrences one word longer; counts them by group over all blocks; and semi-joins every block's occurrences with
the frequent groups before the next round. Only phrases whose two shorter ends are frequent are ever counted, which loses
none. Groups travel from a block to the shuffle once each, with their count; the answer names the frequent ones by number.

The scores are joins on the phrases found, in column functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm import wordscan
from tallyforge.llm.packed import by_bucket, narrow, pack, unpack, word_buckets
from tallyforge.session import cut

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase inside a longer one with this share, in percent, of its occurrences is dropped.
INSIDE = 80
#: Bytes of text in the blocks of a task at a time, and about the groups of a bucket.
BLOCK_BYTES = 16_000_000
BUCKET_GROUPS = 1_000_000
#: Parts in which a language's candidates are ranked first.
SALTS = 64
UNKNOWN = "und"
_SAME = bytes(range(256))
_TABLE = _SAME.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "))
_GROUPS = "block long, lang string, bucket long, keys binary"
#: Answers to blocks have no id; frequent groups have no answer.
_COUNTED = "block long, lang string, bucket long, answer binary, id long, a long, b long, phrase string, n long"


class _Words(dict):
    """Numbers of words from 1 on, as they come; a piece ends with 0."""

    def __missing__(self, word):
        self[word] = number = len(self) - 1
        return number


_NOTHING = 0xFFFFFFFF


def _block(number: int, lang: str, texts: list[str]) -> tuple:
    words, parts = _Words({b"\n": 0, b"": _NOTHING}), []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        found.append(b"\n")
        ids = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
        parts.append(ids[ids != _NOTHING])
    ids = np.concatenate(parts)
    n = np.bincount(ids, minlength=len(words) - 1)[1:]
    return number, lang, int(n.sum()), len(n), pack(narrow(ids)), pack((list(words)[2:], narrow(n)))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    names = ["block", "lang", "words", "groups", "data", "keys"]

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 33, {}, 0

        def rows():
            return pd.DataFrame([_block(number + i, lang, held[lang]) for i, lang in enumerate(sorted(held))], columns=names)

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if held and size + len(text) > block_bytes:
                    yield rows()
                    number, held, size = number + len(held), {}, 0
                held.setdefault(lang, []).append(text)
                size += len(text)
        if held:
            yield rows()

    return docs.mapInPandas(run, "block long, lang string, words long, groups long, data binary, keys binary")


def send_words(buckets: int):
    def run(batches):
        for pdf in batches:
            for block, lang, keys in zip(pdf["block"], pdf["lang"], pdf["keys"]):
                words, n = unpack(keys)
                out = [(block, lang, b, pack((b"\n".join([words[i] for i in at.tolist()]), narrow(n[at]))))
                       for b, at in by_bucket(word_buckets(words, buckets))]
                yield pd.DataFrame(out, columns=["block", "lang", "bucket", "keys"])

    return run


def _frame(blocks, lang, bucket, sizes, flags, ids, frequent) -> pd.DataFrame:
    """The answers to the blocks, and (id, a, b, phrase, n) of the frequent groups."""
    ends = np.cumsum(sizes)
    out = [(block, lang, bucket, pack((np.packbits(flags[e - s:e]), narrow(ids[e - s:e][flags[e - s:e]]))), -1, -1, -1, None, 0)
           for block, s, e in zip(blocks, sizes, ends) if flags[e - s:e].any()]
    out += [(-1, lang, bucket, None, *row) for row in frequent]
    return pd.DataFrame(out, columns=["block", "lang", "bucket", "answer", "id", "a", "b", "phrase", "n"])


def _count_words(least: int, buckets: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        index, of, n = {}, [], []
        for keys in pdf["keys"]:
            joined, times = unpack(keys)
            of.append(np.array([index.setdefault(w, len(index)) for w in joined.split(b"\n")], np.int64))
            n.append(times.astype(np.int64))
        of, sizes = np.concatenate(of), [len(x) for x in of]
        total = np.zeros(len(index), np.int64)
        np.add.at(total, of, np.concatenate(n))
        words = list(index)
        kept = sorted((i for i in np.flatnonzero(total >= least).tolist()), key=words.__getitem__)
        ids = np.zeros(len(index), np.uint64)
        ids[kept] = np.arange(len(kept), dtype=np.uint64) * np.uint64(buckets) + np.uint64(key[1])
        return _frame(pdf["block"].tolist(), key[0], key[1], sizes, (total >= least)[of], ids[of],
                      [(int(ids[i]), -1, -1, words[i].decode("utf-8", "surrogatepass"), int(total[i])) for i in kept])

    return run


def _adjacent(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences one word longer in a block: their places, their group, and (a, b, n) of the groups in order."""
    relation, ids = unpack(data)
    both = np.flatnonzero((relation[:-1] > 0) & (relation[1:] > 0))
    key, group, n = np.unique((relation[both].astype(np.uint64) << np.uint64(32)) | relation[both + 1], return_inverse=True, return_counts=True)
    ids = ids.astype(np.uint64)
    return len(relation), both, group, ids[(key >> np.uint64(32)).astype(np.int64) - 1], ids[(key & np.uint64(_NOTHING)).astype(np.int64) - 1], n


def _pair_buckets(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    return (wordscan.mix(wordscan.mix(a, 3) + b, 4) % np.uint64(buckets)).astype(np.int64)


def _send_pairs(buckets: int):
    def run(batches):
        for pdf in batches:
            for block, lang, data in zip(pdf["block"], pdf["lang"], pdf["data"]):
                _, _, _, a, b, n = _adjacent(data)
                out = []
                for bucket, at in by_bucket(_pair_buckets(a, b, buckets)):
                    out.append((block, lang, bucket, pack((narrow(np.diff(a[at], prepend=np.uint64(0))), narrow(b[at]), narrow(n[at])))))
                yield pd.DataFrame(out, columns=["block", "lang", "bucket", "keys"])

    return run


def _count_pairs(least: int, buckets: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(k) for k in pdf["keys"]]
        a = np.concatenate([np.cumsum(p[0].astype(np.uint64), dtype=np.uint64) for p in parts])
        b = np.concatenate([p[1].astype(np.uint64) for p in parts])
        n = np.concatenate([p[2].astype(np.int64) for p in parts])
        sizes = [len(p[1]) for p in parts]
        order = np.lexsort((b, a))
        first = np.flatnonzero(np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))))
        total = np.add.reduceat(n[order], first)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        kept = np.flatnonzero(total >= least)
        ids = np.zeros(len(first), np.uint64)
        ids[kept] = np.arange(len(kept), dtype=np.uint64) * np.uint64(buckets) + np.uint64(key[1])
        at = order[first[kept]]
        frequent = zip(ids[kept].tolist(), a[at].tolist(), b[at].tolist(), [None] * len(kept), total[kept].tolist())
        return _frame(pdf["block"].tolist(), key[0], key[1], sizes, (total >= least)[group], ids[group], frequent)

    return run


def _answers(frame: pd.DataFrame, bucket: np.ndarray) -> np.ndarray:
    """The id of every group of a block, plus 1; 0 for those that are not frequent."""
    out, places = np.zeros(len(bucket), np.uint64), dict(by_bucket(bucket))
    for b, answer in zip(frame["bucket"].tolist(), frame["answer"]):
        flags, ids = unpack(answer)
        at = places[b]
        out[at[np.unpackbits(flags, count=len(at)).astype(bool)]] = ids.astype(np.uint64) + np.uint64(1)
    return out


def _state(block, lang, relation: np.ndarray) -> pd.DataFrame:
    """The relation with the block's own numbers of the phrases, in the order of their ids."""
    found, own = np.unique(relation, return_inverse=True)
    if not len(found) or found[0] != 0:
        found, own = np.concatenate((np.zeros(1, np.uint64), found)), own + 1
    pairs = int(((own[:-1] > 0) & (own[1:] > 0)).sum())
    return pd.DataFrame([(block, lang, pairs, pack((narrow(own), narrow(found[1:] - np.uint64(1)))))],
                        columns=["block", "lang", "groups", "data"])


def _first_relation(buckets: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["block", "lang", "groups", "data"])
        words, _ = unpack(left["keys"].iloc[0])
        ids = np.concatenate((np.zeros(1, np.uint64), _answers(right, word_buckets(words, buckets))))
        return _state(key[0], left["lang"].iloc[0], ids[unpack(left["data"].iloc[0])])

    return run


def _next_relation(buckets: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["block", "lang", "groups", "data"])
        size, places, group, a, b, _ = _adjacent(left["data"].iloc[0])
        relation = np.zeros(size, np.uint64)
        relation[places] = _answers(right, _pair_buckets(a, b, buckets))[group]
        return _state(key[0], left["lang"].iloc[0], relation)

    return run


def _round(state: DataFrame, send, count, advance, least: int, bucket_groups: int, last: bool) -> tuple[DataFrame | None, DataFrame]:
    """The next relation, and the frequent groups (lang, id, a, b, phrase, n)."""
    total = state.agg(F.coalesce(F.sum("groups"), F.lit(0))).first()[0]
    buckets = 8 + int(total // bucket_groups)
    sent = state.mapInPandas(send(buckets), _GROUPS)
    counted = cut(sent.groupBy("lang", "bucket").applyInPandas(count(least, buckets), _COUNTED), "phrase-groups")
    frequent = counted.filter("id >= 0").select("lang", "id", "a", "b", "phrase", "n")
    if last:
        return None, frequent
    answers = counted.filter("id < 0").select(F.col("block").alias("of_block"), "bucket", "answer")
    grown = state.groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(
        advance(buckets), "block long, lang string, groups long, data binary")
    return cut(grown, "occurrences"), frequent


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST,
                     block_bytes: int = BLOCK_BYTES, bucket_groups: int = BUCKET_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of up to ``longest`` words with ``least`` occurrences, and (lang, n) of all words."""
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    state = cut(_blocks(plain, block_bytes), "pieces")
    words = state.groupBy("lang").agg(F.sum("words").alias("n"))
    state, found = _round(state, send_words, _count_words, _first_relation, least, bucket_groups, longest == 1)
    found = found.select("lang", "id", "phrase", F.col("phrase").alias("last"), "n")
    sizes = [found.withColumn("size", F.lit(1))]
    for size in range(2, longest + 1):
        state, groups = _round(state, _send_pairs, _count_pairs, _next_relation, least, bucket_groups, size == longest)
        left = found.select("lang", F.col("id").alias("a"), F.col("phrase").alias("head"))
        right = found.select("lang", F.col("id").alias("b"), "last")
        found = cut(groups.drop("phrase").join(left, ["lang", "a"]).join(right, ["lang", "b"]).select(
            "lang", "id", F.concat("head", F.lit(" "), "last").alias("phrase"), "last", "n"), "phrases")
        sizes.append(found.withColumn("size", F.lit(size)))
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out.select("lang", "phrase", "size", "n"), words


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST,
         top: int = TOP, inside: int = INSIDE, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two words and more.

    The score of a phrase is its worst cut's ``2000000 * a // (l + r)``; phrases with ``inside`` percent or more of their
    occurrences inside one longer candidate are dropped. Repeated rows count each. Null texts have no words, null languages
    count as ``und``; other columns play no part. No rows, or no phrase that is frequent: no rows.
    """
    found, words = frequent_phrases(docs, lang_col, text_col, longest, least, **options)
    found = cut(found, "frequent")
    parts = F.split("phrase", " ")
    candidates = found.filter("size > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), parts.alias("w"), "size").select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.expr("slice(w, 1, k)")).alias("head"),
        F.concat_ws(" ", F.expr("slice(w, k + 1, size - k)")).alias("tail"))
    side = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).withColumn(
        "score", F.expr("(2000000BD * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    longer = candidates.filter("size > 2").select("lang", parts.alias("w"), "a", "size").select(
        "lang", "w", "a", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m")).select(
        "lang", "w", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i")).select(
        "lang", F.concat_ws(" ", F.expr("slice(w, i, m)")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = worst.join(longer, ["lang", "phrase"], "left").filter(
        F.expr(f"around is null or cast(around as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {inside}"))
    kept = kept.select("lang", "phrase", "a", "x.l", "x.r", F.col("x.score").cast("long").alias("score"))
    by = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("i", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*by))).filter(F.col("i") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
