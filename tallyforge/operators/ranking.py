"""Positions inside groups that may hold any share of the rows.

A plain window puts a whole group into one task. These helpers check the
longest group first (one map-side combined count) and, beyond the limit,
range-partition by (group, order) so that a long group spreads over many
partitions, then add up the counts of the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.session import cut
from tallyforge.settings import Settings


def longest_group(df: DataFrame, group: Sequence[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def range_split(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned by (group, order) and written down with their part number.

    Written because the part boundaries are sampled: a recomputation could
    draw them elsewhere.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in (*group, *order)])
    return cut(parts.withColumn("_part", F.spark_partition_id()), "range-split")


def part_sums(split: DataFrame, group: Sequence[str], **sums) -> DataFrame:
    """Per (group, part) the totals over all earlier parts of the group."""
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = split.groupBy(*group, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    return per_part.select(
        *group, "_part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums]
    )


def join_parts(split: DataFrame, per_part: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, "_part"]
    extra = [c for c in per_part.columns if c not in keys]
    right = per_part.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return split.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "rank",
    settings: Settings = Settings(),
) -> DataFrame:
    """``row_number`` by ``order`` (which must be unique inside a group)."""
    if longest_group(df, group) <= settings.max_window_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    split = range_split(df, group, order)
    before = part_sums(split, group, _before=F.count("*"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        join_parts(split.withColumn("_inside", F.row_number().over(inside)), before, group)
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_inside", "_before", "_part")
    )
