"""Joins that check sizes and keys first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyforge.session import cut


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only when the side has at most ``max_rows`` rows; else the plan decides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(
    many: DataFrame, one: DataFrame, key: str, hot_rows: int, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join where some keys of ``many`` hold very many rows.

    Keys above ``hot_rows`` are split into ``salts`` parts; only for those keys
    is the other side copied, once per part. All other keys join as usual, in
    the same shuffle. The list of hot keys is written, counted and sent to all
    tasks if it is small, so a hot key is not shuffled before it is salted; the
    salt is drawn per row from a fixed seed, so equal rows spread as well.
    Right and full joins are refused: unmatched copies of the other side would
    come out once per part.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps rows of the many side only, not {how}")
    hot = broadcast_if_small(cut(many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(
        key, F.lit(True).alias("_hot")), "hot-keys"))
    is_hot = F.coalesce("_hot", F.lit(False))
    left = many.join(hot, key, "left").withColumn(
        "_salt", F.when(is_hot, F.floor(F.rand(11) * salts).cast("int")).otherwise(0)
    ).drop("_hot")
    right = one.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "1:1", how: str = "full"
) -> DataFrame:
    """Merge with key-uniqueness checks ('1:1', '1:m', 'm:1', 'm:m') and a source flag per row."""
    left_one, right_one = (side == "1" for side in validate.split(":"))
    for wanted, df, name in ((left_one, left, "left"), (right_one, right, "right")):
        if wanted and not duplicate_keys(df, keys).isEmpty():
            raise ValueError(f"merge keys are not unique on the {name} side")
    merged = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), how)
    flag = (
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
        .when(F.col("_l").isNotNull(), "left_only").otherwise("right_only"))
    return merged.withColumn("source_flag", flag).drop("_l", "_r")
