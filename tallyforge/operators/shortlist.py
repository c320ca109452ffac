"""Fuzzy candidate shortlist, equal to comparing everything with everything.

Without vectors most records are settled by their reference alone. Distinct references meet when they (or their digits
without leading zeros) are equal, contain one another, or become equal after deleting one character on either side. A
record leaves as soon as it has ``k`` candidates that no pair left unseen can beat; its shortlist is then complete.

The references that stay open are a query set that goes against all distinct references of the pool, in blocks: chunks of
references and blocks meet once each. Within a meeting the block's texts are walked by their beginnings, and a beginning is left
as soon as no text with it can reach the score that ``k`` rows reach already (or, where none is known, a strong score that ``k``
of the block's texts reach). Those that are similar to fewer than ``k`` rows, so that names count, meet all distinct pool rows
in the same way and are compared with all of a block at once. With vectors every record is. There is no limit on depth or on
compared pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions import similarity, text
from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut
from tallyforge.settings import Settings

# Fixed values of the hybrid score.
STRONG_REFERENCE = 0.75
BLEND_REFERENCE, BLEND_SEMANTIC = 0.7, 0.3
WEIGHT_REFERENCE, WEIGHT_NAME, WEIGHT_SEMANTIC = 0.4, 0.3, 0.3


def semantic_score(a: Column, b: Column) -> Column:
    """F6. Dot product of two unit vectors, kept inside [0, 1]; 0 when one is missing."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)), F.lit(0.0))


def hybrid_score(ref: Column, name: Column, semantic: Column) -> Column:
    """F8."""
    return F.when(
        ref >= STRONG_REFERENCE, F.greatest(ref, BLEND_REFERENCE * ref + BLEND_SEMANTIC * semantic)
    ).otherwise(WEIGHT_REFERENCE * ref + WEIGHT_NAME * name + WEIGHT_SEMANTIC * semantic)


def reference_score(a: Column, b: Column) -> Column:
    """F4 on upper-cased, trimmed references."""
    return similarity.reference_ratio(a, b)


def name_score(a: Column, b: Column) -> Column:
    """F5. 0 when a name is missing."""
    present = text.blank_to_null(a).isNotNull() & text.blank_to_null(b).isNotNull()
    score = similarity.indel_ratio(
        text.sorted_tokens(F.coalesce(a, F.lit(""))), text.sorted_tokens(F.coalesce(b, F.lit(""))))
    return F.when(present, score).otherwise(0.0)


def _delete_one(texts: Column) -> Column:
    """All texts with one character less, for an array of texts."""
    shorter = F.transform(
        texts,
        lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        ),
    )
    return F.array_distinct(F.flatten(shorter))


def _edit_keys(c: Column, kind: str, level: int) -> Column:
    """Keys of a text: itself and what is left after up to ``level`` deletions."""
    grown = current = F.array(c)
    for depth in range(1, level + 1):
        current = F.when(F.length(c) >= 4 * depth, _delete_one(current)).otherwise(
            F.array().cast("array<string>"))
        grown = F.concat(grown, current)
    return F.transform(F.array_distinct(grown), lambda s: F.concat(F.lit(kind), s))


def _keys(ref: Column, level: int) -> Column:
    digits = text.digit_key(ref)
    digit_keys = F.when(digits != "", _edit_keys(digits, "D:", level)).otherwise(
        F.array().cast("array<string>"))
    return F.explode(F.concat(_edit_keys(ref, "R:", level), digit_keys))


def _contained(r: DataFrame, p: DataFrame) -> DataFrame:
    """(r, p) where one text contains the other, by joining texts with substrings."""

    def windows(long_: DataFrame, lengths: list[int], name: str) -> DataFrame:
        return long_.select(name, F.explode(text.substrings_of(F.col(name), lengths)).alias("part")).filter(
            F.length("part") < F.length(name))

    out = r.join(p, F.col("r") == F.col("p")).select("r", "p")
    r_lengths, p_lengths = _lengths(r, "r"), _lengths(p, "p")
    if r_lengths and p_lengths:
        out = out.unionByName(
            windows(p, r_lengths, "p").join(r, F.col("part") == F.col("r")).select("r", "p"))
        out = out.unionByName(
            windows(r, p_lengths, "r").join(p, F.col("part") == F.col("p")).select("r", "p"))
    return out


def _lengths(df: DataFrame, name: str) -> list[int]:
    """Distinct text lengths: never more than the longest reference has characters."""
    return sorted(x.n for x in df.select(F.length(name).alias("n")).distinct().collect())


def _unseen_bound(r_len: Column, p_lengths: list[int], level: int, whole: bool) -> Column:
    """Highest ratio a pair can have that was not found up to ``level`` deletions.

    Not found means LCS <= longer - level - 1 (and no containment). ``whole``
    is the plain ratio; otherwise the best window of the longer text counts.
    """
    best = F.lit(0.0)
    for m in p_lengths:
        low = F.least(r_len, F.lit(m)).cast("double")
        high = F.greatest(r_len, F.lit(m)).cast("double")
        lcs = F.least(low, high - level - 1)
        plain = 2 * lcs / (low + high)
        window = F.least(lcs, low - 1)
        partial = F.greatest(2 * window / (low + window), window / low)
        best = F.greatest(best, plain if whole else F.greatest(plain, partial))
    return best


def reference_pairs(records: DataFrame, pool: DataFrame, k: int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Scored pairs (r, p, ref_score) of distinct references, and the references (r) whose top ``k`` they need not hold.

    ``pool`` brings ``n``, the number of pool rows behind each text.
    """
    p_lengths = _lengths(pool, "p")
    d_lengths = _lengths(
        pool.select(text.digit_key(F.col("p")).alias("p")).filter("p <> ''").distinct(), "p")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_r, scored = records, None
    for level in range(depth + 1):
        keyed = (
            open_r.select("r", _keys(F.col("r"), level).alias("key"))
            .join(pool.select("p", _keys(F.col("p"), level).alias("key")), "key")
            .select("r", "p")
        )
        if level == 0:
            keyed = keyed.unionByName(_contained(open_r, pool.select("p")))
        # A fixed number of parts: scoring costs time, not bytes, and adaptive
        # merging of small shuffle parts would leave it to one or two tasks.
        # Pairs of one record lie together, as they are scored together.
        new = keyed.repartition(parts, "r").distinct().sortWithinPartitions("r")
        if scored is not None:
            new = new.join(scored.select("r", "p"), ["r", "p"], "left_anti").repartition(parts, "r").sortWithinPartitions("r")
        new = cut(new.withColumn("ref_score", reference_score(F.col("r"), F.col("p"))), f"pairs-{level}")
        scored = new if scored is None else scored.unionByName(new)
        bound = F.greatest(
            _unseen_bound(F.length("r"), p_lengths, level, whole=False),
            _unseen_bound(F.length(text.digit_key(F.col("r"))), d_lengths, level, whole=True),
        )
        limits = open_r.select("r", F.greatest(bound, F.lit(STRONG_REFERENCE)).alias("limit"))
        settled = (
            scored.join(limits, "r")
            .filter(F.col("ref_score") > F.col("limit"))
            .join(pool, "p")
            .groupBy("r")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= k)
        )
        open_r = cut(open_r.join(settled.select("r"), "r", "left_anti"), f"open-{level}")
        if open_r.isEmpty():
            break
    return scored, open_r


#: Records of a chunk and pool rows of a block, about; most tasks, as the driver keeps count of each.
CHUNK, BLOCK, TASKS = 1000, 16384, 2000
#: The same for references that are searched, and how many are searched at once.
SEARCH_CHUNK, SEARCH_BLOCK, SEARCH_BATCH, SEARCH_LEAST = 16384, 131072, 512, 250
#: The floors that a reference without a bound is searched by, until ``k`` texts of the block reach one.
FLOORS = (0.93, 0.91, 0.9, 0.88, 0.86, 0.84, 0.82, 0.8, 0.78, STRONG_REFERENCE)
#: What scores may differ by and still be listed as equal.
ROUNDING = 1e-4
_FOUND = "u long, cls long, ref_score double, name_score double, semantic_score double"


def _nearest_of_block(k: int):
    """The ``k`` best texts of a block for every reference of a chunk, of those with a strong score; alike, the first in the pool."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"r": [], "p": [], "ref_score": []}, dtype=object)
        texts, order, out = right["p"].to_numpy(object), right["first"].to_numpy(np.int64), []
        near = similarity.Near(texts.tolist())
        for at in range(0, len(left), SEARCH_BATCH):
            asking, bounds = (left[c].iloc[at:at + SEARCH_BATCH].to_numpy(kind) for c, kind in (("r", object), ("bound", float)))
            for step, floor in enumerate(FLOORS):
                # The first time those that have a bound go by it, and are done.
                floors = np.where(np.isnan(bounds), floor, bounds)
                who, text, score = near.pairs(asking.tolist(), (floors - ROUNDING).tolist())
                done = ~np.isnan(bounds) | (np.bincount(who[score >= floors[who]], minlength=len(asking)) >= k) | (step == len(FLOORS) - 1)
                some = np.flatnonzero(done[who] & (score >= STRONG_REFERENCE))
                who, text, score = who[some], text[some], score[some]
                some = np.lexsort((order[text], -np.rint(score * 1e4), who))
                some = some[np.arange(len(some)) - np.searchsorted(who[some], who[some]) < k]
                out.append((asking[who[some]], texts[text[some]], score[some]))
                asking, bounds = asking[~done], bounds[~done]
                if not len(asking):
                    break
        return pd.DataFrame({name: pd.Series(np.concatenate(x), dtype=x[0].dtype) for name, x in zip(("r", "p", "ref_score"), zip(*out))})

    return run


def nearest(open_r: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(r, p, ref_score): for each of ``open_r`` (r, bound) the ``k`` nearest of every block of ``texts`` (p, first), if strong.

    ``bound`` is a strong score that ``k`` rows of the pool are known to reach, or null; what is below it need not be found.
    """
    n, turns = open_r.count(), -(-texts.count() // SEARCH_BLOCK)
    chunks = max(1, n // SEARCH_CHUNK, min(n // SEARCH_LEAST, open_r.sparkSession.sparkContext.defaultParallelism * 2))
    found = _meet(open_r, "r", chunks, texts, "p", max(1, turns), chunks * turns)
    return found.applyInPandas(_nearest_of_block(k), "r string, p string, ref_score double")


def _meet(asked: DataFrame, key: str, chunks: int, came: DataFrame, other: str, turns: int, meetings: int):
    """Every chunk of ``asked`` with every block of ``came``."""
    parts = min(TASKS, max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), meetings))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("chunk", place(key, chunks)).withColumn("turn", every(turns)).repartition(parts, "chunk", "turn")
    came = came.withColumn("at", place(other, turns)).withColumn("to", every(chunks)).repartition(parts, "to", "at")
    return asked.groupBy("chunk", "turn").cogroup(came.groupBy("to", "at"))


def _best_of_block(k: int, least: float, with_vectors: bool):
    """The ``k`` best pool classes of a block for every record of a chunk."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": [], "cls": [], "ref_score": [], "name_score": [], "semantic_score": []})
        if not len(left) or not len(right):
            return none
        refs, ref_of = np.unique(right["p"].to_numpy(str), return_inverse=True)
        names, name_of = np.unique(right["p_key"].fillna("").to_numpy(str), return_inverse=True)
        references, texts, cls = similarity.References(refs.tolist()), similarity.Texts(names.tolist()), right["cls"].to_numpy(np.int64)
        named = right["p_key"].notna().to_numpy()
        there = np.flatnonzero(right["p_vector"].notna()) if with_vectors else []
        vectors = np.stack(right["p_vector"].iloc[there].to_numpy()).astype(np.float64) if len(there) else None
        out, by_name = [], {}
        for r, rows in left.groupby("r"):
            ref = references.scores(r)[ref_of]
            for row in rows.itertuples():
                if pd.isna(row.r_key):
                    name = np.zeros(len(right))
                else:
                    if row.r_key not in by_name:
                        by_name[row.r_key] = np.where(named, similarity.indel_to_all(row.r_key, texts)[name_of], 0.0)
                    name = by_name[row.r_key]
                semantic = np.zeros(len(right))
                if with_vectors and vectors is not None and row.r_vector is not None:
                    semantic[there] = np.clip(vectors @ np.asarray(row.r_vector, np.float64), 0, 1)
                score = np.where(ref >= STRONG_REFERENCE, np.maximum(ref, BLEND_REFERENCE * ref + BLEND_SEMANTIC * semantic),
                                 WEIGHT_REFERENCE * ref + WEIGHT_NAME * name + WEIGHT_SEMANTIC * semantic)
                some = np.flatnonzero(score >= least)
                rounded = np.rint(score[some] * 1e4)
                if len(some) > k:
                    kept = rounded >= np.partition(rounded, len(some) - k)[len(some) - k]
                    some, rounded = some[kept], rounded[kept]
                some = some[np.lexsort((cls[some], -rounded))[:k]]
                out.append(pd.DataFrame({"u": row.u, "cls": cls[some], "ref_score": ref[some], "name_score": name[some],
                                         "semantic_score": semantic[some]}))
        return pd.concat(out) if out else none

    return run


def _name_key(name: str) -> Column:
    """Sorted tokens of a name; null for a missing one."""
    return F.when(text.blank_to_null(F.col(name)).isNotNull(), text.sorted_tokens(F.col(name)))


def compared(records: DataFrame, classes: DataFrame, k: int, least: float, with_vectors: bool) -> DataFrame:
    """(u, cls, ref_score, name_score, semantic_score): for each of ``records`` the ``k`` best of every block of ``classes``.

    ``records`` are (u, r, r_key[, r_vector]), ``classes`` (cls, p, p_key[, p_vector]); every record meets every class once.
    """
    chunks, turns = max(1, records.count() // CHUNK), max(1, classes.count() // BLOCK)
    met = _meet(records, "u", chunks, classes, "cls", turns, chunks * turns // 4)
    return met.applyInPandas(_best_of_block(k, least, with_vectors), _FOUND)


def shortlist(records: DataFrame, pool: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """F9. (id, ref, name[, vector]) x (id, ref, name, pos[, vector]) -> the top-k rows per record.

    ``pos`` is the pool order that breaks ties. Optional unit vectors add the
    semantic part; without them it is 0. Output: record_id, candidate_id, the
    four scores rounded to four decimals, and rank.
    """
    k = settings.top_k
    with_vectors = "vector" in records.columns and "vector" in pool.columns
    rec = records.select(
        F.col("id").alias("record_id"), text.reference_key(F.col("ref")).alias("r"),
        F.col("name").alias("r_name"), *([F.col("vector").alias("r_vector")] if with_vectors else []),
    ).filter("r is not null")
    cand = pool.select(
        F.col("id").alias("candidate_id"), text.reference_key(F.col("ref")).alias("p"),
        F.col("name").alias("p_name"), F.col("pos").alias("pos"),
        *([F.col("vector").alias("p_vector")] if with_vectors else []),
    ).filter("p is not null")
    first = lambda keys, df: with_rank(df, keys, ["pos", "candidate_id"], "_i", settings).filter(
        F.col("_i") <= k).drop("_i")
    r_class = ["r", "r_name", *(["r_vector"] if with_vectors else [])]
    p_class = ["p", "p_name", *(["p_vector"] if with_vectors else [])]
    # Records that are alike are listed once and share their list.
    classes = cut(rec.select(*r_class).distinct().withColumn("u", F.monotonically_increasing_id()), "record-classes")
    ordered = with_rank(cand.withColumn("_all", F.lit(0)), ["_all"], ["pos", "candidate_id"], "cls", settings).drop("_all")
    open_classes, settled = classes, None
    if not with_vectors:
        ordered = cut(ordered, "pool-rows")
        texts = cut(ordered.groupBy("p").agg(F.count("*").alias("n"), F.min("cls").alias("first")), "pool-texts")
        pairs, open_r = reference_pairs(cut(rec.select("r").distinct(), "record-texts"), texts.select("p", "n"), k)
        strong = pairs.filter(F.col("ref_score") >= STRONG_REFERENCE)
        # The strong score that k rows of the pool reach already.
        reached = Window.partitionBy("r").orderBy(F.desc("ref_score"), "p").rowsBetween(Window.unboundedPreceding, 0)
        bounds = strong.join(open_r, "r").join(texts, "p").withColumn(
            "_n", F.sum("n").over(reached)).filter(F.col("_n") >= k).groupBy("r").agg(F.max("ref_score").alias("bound"))
        found = cut(nearest(cut(open_r.join(bounds, "r", "left"), "bounds"), texts.select("p", "first"), k), "nearest")
        full = found.join(texts, "p").groupBy("r").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("r")
        strong = strong.join(open_r, "r", "left_anti").unionByName(found.join(full, "r", "left_semi"))
        open_classes = classes.join(open_r, "r", "left_semi").join(full, "r", "left_anti")
        # With a strong reference the name does not count, so rows of one reference score alike.
        by_ref = Window.partitionBy("r").orderBy(F.desc(F.bround("ref_score", 4)), "pos", "candidate_id")
        strong = strong.join(first(["p"], ordered.drop("cls")), "p")
        strong = strong.withColumn("_i", F.row_number().over(by_ref)).filter(F.col("_i") <= k).drop("_i", "p")
        settled = cut(classes.join(strong, "r").select(
            "u", "candidate_id", "pos", "ref_score", name_score(F.col("r_name"), F.col("p_name")).alias("name_score"),
            F.lit(0.0).alias("semantic_score")), "strong-rows")

    # Rows of one pool class score alike too: its first k in pool order are all a list can take.
    members = cut(first(p_class, ordered).withColumn("cls", F.min("cls").over(Window.partitionBy(*p_class)).cast("long")), "pool-classes")
    asked, listed = cut(open_classes.withColumn("r_key", _name_key("r_name")).drop("r_name"), "open-classes"), settled
    if settled is None or not asked.isEmpty():
        came = members.withColumn("p_key", _name_key("p_name")).drop("candidate_id", "pos", "p_name").dropDuplicates(["cls"])
        found = compared(asked, cut(came, "compared-classes"), k, settings.min_candidate_score, with_vectors)
        listed = found.join(members.select("cls", "candidate_id", "pos"), "cls").drop("cls")
        listed = listed if settled is None else listed.unionByName(settled)
    listed = listed.withColumn(
        "similarity_score", hybrid_score(F.col("ref_score"), F.col("name_score"), F.col("semantic_score"))).filter(
        F.col("similarity_score") >= settings.min_candidate_score).select(
        "u", "candidate_id", "pos",
        *[F.bround(c, 4).alias(c) for c in ("similarity_score", "ref_score", "name_score", "semantic_score")])
    w = Window.partitionBy("u").orderBy(F.desc("similarity_score"), "pos", "candidate_id")
    top = listed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pos")
    on = None
    for c in r_class:
        cond = rec[c].eqNullSafe(classes[c])
        on = cond if on is None else on & cond
    named = rec.join(classes, on).select("record_id", "u")
    return named.join(top, "u").select(
        "record_id", "candidate_id", "similarity_score", "ref_score", "name_score", "semantic_score", "rank")


def bank_records(bank: DataFrame) -> DataFrame:
    return bank.select(
        F.col("settlement_id").alias("id"), F.col("utr_reference").alias("ref"),
        F.col("payer_account").alias("name"), F.struct("date", "settlement_id").alias("pos"))


def ledger_records(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        F.col("order_id").alias("id"), F.col("customer_reference").alias("ref"),
        F.col("customer_name").alias("name"), F.struct("ingest_seq", "order_id").alias("pos"))
