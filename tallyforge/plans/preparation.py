"""Example checks, copies, splits, chunks and neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions.money import strip
from tallyforge.operators.neighbours import neighbours
from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut, spread

# Refusal patterns, length limits and the LSH layout for a
# Jaccard threshold of 0.8 (bands x rows of the 128 permutations).
REFUSALS = [r"I cannot", r"I'm sorry, but", r"As an AI", r"I don't have access", r"\[.*\]$"]
MAX_TOTAL_TOKENS = 4096
PERMUTATIONS, BANDS, ROWS = 128, 21, 6


def to_instructions(conversations: DataFrame) -> DataFrame:
    """V6. Each user turn with the assistant turn right after it, as one example."""
    ask = conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("instruction"))
    reply = conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return ask.join(reply, ["conv_id", "turn"])


def to_messages(examples: DataFrame, system_prompt: str = "") -> DataFrame:
    """V6. Examples to role/content rows in order (position), system prompt first when given."""
    message = lambda n, role, c: F.struct(F.lit(n).alias("position"), F.lit(role).alias("role"), c.alias("content"))
    parts = [message(1, "user", F.col("instruction")), message(2, "assistant", F.col("output"))]
    if system_prompt:
        parts.insert(0, message(0, "system", F.lit(system_prompt)))
    return examples.select("conv_id", "turn", F.inline(F.array(*parts)))


def tokens(c: Column) -> Column:
    """Whitespace words, the stand-in for a tokenizer's count."""
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def example_stats(examples: DataFrame) -> DataFrame:
    """V1."""
    n_in, n_out = tokens(F.col("instruction")), tokens(F.col("output"))
    key = F.sha2("instruction", 256)
    distinct = examples.select(key.alias("k")).distinct().agg(F.count("*").alias("distinct_inputs"))
    return examples.agg(
        F.count("*").alias("total_examples"), F.avg(n_in).alias("avg_input_length"),
        F.avg(n_out).alias("avg_output_length"), F.max(n_in).alias("max_input_length"),
        F.max(n_out).alias("max_output_length"), F.count_if(n_in == 0).alias("empty_inputs"),
        F.count_if(n_out == 0).alias("empty_outputs"), F.count_if(n_in + n_out > MAX_TOTAL_TOKENS).alias("too_long"),
    ).join(distinct, F.lit(True)).withColumn(
        "duplicate_count", F.col("total_examples") - F.col("distinct_inputs")).drop("distinct_inputs")


def quality_filter(
    examples: DataFrame, min_input: int = 10, max_input: int = 2048, min_output: int = 5, max_output: int = 2048
) -> DataFrame:
    """V2."""
    out = F.col("output")
    bad = F.lit(False)
    for p in REFUSALS:
        bad = bad | out.rlike(f"(?i){p}")
    return examples.filter(
        tokens(F.col("instruction")).between(min_input, max_input) & tokens(out).between(min_output, max_output)
        & (strip(out) != "") & ~bad)


def drop_exact_copies(df: DataFrame, key: str, order: str) -> DataFrame:
    """V3. First row per text; the text is compared by its hash, and only ids are shuffled."""
    first = df.groupBy(F.sha2(key, 256).alias("k")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


# --------------------------------------------------------------------- near copies

def _signature(seed: int = 1):
    rng = np.random.default_rng(seed)
    prime = np.uint64((1 << 31) - 1)
    a = rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint64)
    b = rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64)

    @F.pandas_udf("array<long>")
    def udf(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            x = np.asarray(h, dtype=np.int64).astype(np.uint64) % prime
            best = np.full(PERMUTATIONS, prime, dtype=np.uint64)
            for i in range(0, len(x), 512):  # bounded blocks, so a long text needs little memory
                best = np.minimum(best, ((a[:, None] * x[None, i : i + 512] + b[:, None]) % prime).min(axis=1))
            out.append(best.astype(np.int64))
        return pd.Series(out)

    return udf


def drop_near_copies(df: DataFrame, id_column: str, text: str, threshold: float = 0.8) -> DataFrame:
    """V4. Ids that stay when every text too similar to an earlier kept one is dropped.

    Texts with the same word set are one candidate. Candidates meet in MinHash
    bands. Per round the open texts of a band are compared with its first ones
    by their exact Jaccard similarity; a text that is among the first of all its
    bands and similar to no open one before it is kept, and what is similar to
    it goes. In the first round that is one text of each band, so copies go
    without being compared with each other; then it is eight times as many each
    round, so that texts that share a band but are not similar take few rounds.
    """
    rows = spread(df.select(F.col(id_column).alias("id"), text.alias("text")))
    words = F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower("text"), r"\s+"), "")))
    sets = cut(
        rows.select("id", words.alias("words")).withColumn("k", F.sha2(F.concat_ws(" ", "words"), 256)), "word-sets")
    first = cut(sets.groupBy("k").agg(F.min("id").alias("id")).select("id"), "first-of-set")
    unique = sets.join(first, "id", "left_semi").select("id", "words")
    empty = unique.filter(F.size("words") == 0).select("id")
    signed = spread(unique.filter(F.size("words") > 0)).withColumn(
        "sig", _signature()(F.transform("words", lambda w: F.xxhash64(w))))
    band = lambda i: F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sig", i * ROWS + 1, ROWS)).alias("h"))
    bands = cut(signed.select("id", F.inline(F.array(*[band(i) for i in range(BANDS)]))), "bands")
    crowded = bands.groupBy("band", "h").agg(F.count("*").alias("n")).filter("n > 1").select("band", "h")
    shared = cut(bands.join(crowded, ["band", "h"], "left_semi"), "shared-bands")
    kept = [empty, signed.select("id").join(shared.select("id").distinct(), "id", "left_anti")]
    sizes = unique.select("id", "words", F.size("words").alias("n"))
    a = sizes.select("id", F.col("words").alias("wa"), F.col("n").alias("na"))
    b = sizes.select(F.col("id").alias("first_id"), F.col("words").alias("wb"), F.col("n").alias("nb"))
    common = F.size(F.array_intersect("wa", "wb"))
    likely = F.least("na", "nb") / F.greatest("na", "nb") >= threshold
    open_, first, close = shared, 1, None
    while not open_.isEmpty():
        if close is None:
            ranked = cut(with_rank(open_.distinct(), ["band", "h"], ["id"], "place"), "ranked-bands")
            ready = ranked.groupBy("id").agg(F.max("place").alias("place")).filter(F.col("place") <= first).select("id")
            pairs = ranked.select("id", "band", "h").join(
                ranked.filter(F.col("place") <= first).select("band", "h", F.col("id").alias("first_id")), ["band", "h"]).filter(
                "first_id < id").select("id", "first_id").distinct()
            near = cut(pairs.join(a, "id").join(b, "first_id").filter(likely).filter(
                common / (F.col("na") + F.col("nb") - common) >= threshold).select("id", "first_id").distinct(), "close")
            if ranked.filter(F.col("place") > first).isEmpty():
                close = near  # all pairs that matter are known now
        else:
            ready, near = open_.select("id").distinct(), close
        new = cut(ready.join(near.select("id"), "id", "left_anti"), "kept")
        kept.append(new)
        dropped = near.join(new.select(F.col("id").alias("first_id")), "first_id", "left_semi").select("id")
        gone = cut(new.unionByName(dropped).distinct(), "decided")
        open_ = cut(open_.join(gone, "id", "left_anti"), "open")
        if close is not None:
            close = cut(close.join(gone, "id", "left_anti").join(
                gone.select(F.col("id").alias("first_id")), "first_id", "left_anti").select("id", "first_id"), "close")
        first *= 8
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.withColumnRenamed("id", id_column)


# --------------------------------------------------------------------- splits and chunks

def stratified_split(df: DataFrame, id_column: str, stratum: str, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """V5. (id, stratum, part): per stratum the rounded share with the lowest id hashes is validation."""
    keyed = df.select(id_column, stratum, F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))).alias("_h"))
    n = keyed.groupBy(stratum).agg(F.rint(F.count("*") * F.lit(test_size)).cast("long").alias("_n"))
    ranked = with_rank(keyed, [stratum], ["_h", id_column], "_i").join(n, stratum)
    return ranked.select(
        id_column, stratum, F.when(F.col("_i") <= F.col("_n"), "validation").otherwise("train").alias("part"))


def fixed_chunks(c: Column, size: int = 500, overlap: int = 50) -> Column:
    """V7. Array of overlapping pieces of at most ``size`` characters; a piece that the text goes on after ends at its last
    space, if that lies beyond 80 % of the size."""
    # A place far inside a text is found by counting characters from its beginning; so a long stretch is cut out first, and
    # the pieces are cut from that.
    total, stretch, least = F.length(c), 64 * size, max(1, int(size * 0.8) - overlap)

    def piece(acc: Column, _: Column, part: Column, base: Column) -> Column:
        at, rest = acc["next"], F.length(part)
        window = F.substring(part, at + 1, F.lit(size))
        space = F.instr(F.reverse(window), " ")
        early = (base + at + size < total) & (space > 0) & (size - space > size * 0.8)
        length = F.when(early, size - space).otherwise(size)
        text = F.regexp_replace(F.substring(window, F.lit(1), length), r"^\s+|\s+$", "")
        grown = F.struct((at + length - overlap).alias("next"), F.concat(acc["pieces"], F.array(text)).alias("pieces"))
        return F.when((base + at < total) & ((at + size <= rest) | (base + rest >= total)), grown).otherwise(acc)

    def cut_out(acc: Column, _: Column) -> Column:
        inner = F.sequence(F.lit(1), F.lit(stretch // least + 1))
        return F.aggregate(F.array(F.substring(c, acc["next"] + 1, F.lit(stretch))), acc, lambda a, part: F.aggregate(
            inner, start, lambda x, i: piece(x, i, part, a["next"]), lambda x: F.struct(
                (a["next"] + x["next"]).alias("next"), F.concat(a["pieces"], x["pieces"]).alias("pieces"))))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("pieces"))
    stretches = F.sequence(F.lit(1), F.floor(total / (stretch - size - overlap)).cast("int") + 1)
    return F.aggregate(stretches, start, cut_out)["pieces"]


def sentence_chunks(c: Column, per_chunk: int = 5, overlap: int = 1) -> Column:
    """V8. Array of struct(text, start_sentence, end_sentence)."""
    sentences = F.filter(
        F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: strip(x)), lambda x: x != "")
    n = F.size(sentences)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(per_chunk - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        F.array_join(F.slice(sentences, i + 1, per_chunk), " ").alias("text"), i.alias("start_sentence"),
        (F.least(i + per_chunk, n) - 1).alias("end_sentence")))


def clean_text(c: Column, prefix: str = "", max_length: int | None = None) -> Column:
    """V20. One space for white space, odd characters removed; whole text unless a length is asked for."""
    s = F.regexp_replace(c, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_ .,!?\-:;()]", "")
    s = strip(s if max_length is None else F.substring(s, 1, max_length))
    s = F.concat(F.lit(prefix), s)
    return s if max_length is None else F.substring(s, 1, max_length)


# --------------------------------------------------------------------- neighbours

def hard_negatives(
    vectors: DataFrame, positives: DataFrame, k: int = 10, take: int = 3, near: DataFrame | None = None
) -> DataFrame:
    """V19. Of the k + 1 nearest rows, the first ``take`` that are no positive of the query.

    ``positives`` is (id, neighbour); ``near`` holds the neighbours if they are known already.
    """
    near = neighbours(vectors, k + 1) if near is None else near
    near = near.join(positives.select("id", "neighbour"), ["id", "neighbour"], "left_anti")
    w = Window.partitionBy("id").orderBy("rank")
    return near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= take)
