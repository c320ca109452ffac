"""Table checks and differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def not_unique(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def without_parent(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with the number of violations."""
    counts = [v.agg(F.count("*").alias("violations")).withColumn("check_name", F.lit(n)) for n, v in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def row_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """B9."""
    counts = [df.agg(F.count("*").alias("n")).withColumn("stage", F.lit(n)) for n, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def metric_variance(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Count, sum, average, minimum and maximum of both sides with the change in percent."""

    def metrics(df: DataFrame, side: str) -> DataFrame:
        c = F.col(column)
        one = df.agg(
            F.count("*").cast("double").alias("count"), F.sum(c).cast("double").alias("sum"),
            (F.sum(c).cast("double") / F.count(c)).alias("avg"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"))
        return one.unpivot([], ["count", "sum", "avg", "min", "max"], "metric", side)

    s, t = F.col("source_value"), F.col("target_value")
    return metrics(source, "source_value").join(metrics(target, "target_value"), "metric").withColumn(
        "pct_variance", F.when(s != 0, F.bround(F.lit(100.0) * (t - s) / s, 4)))


#: Keys that one task compares, about.
ROWS_OF_PART = 1_000_000


def key_differences(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Keys only in the target (new) and only in the source (deleted)."""
    rows = source.select(key, F.lit(0).alias("_side")).unionByName(target.select(key, F.lit(1).alias("_side")))
    # Dealt first, into parts that do not grow with the input: keys rarely repeat, so counting them before holds them all.
    conf = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = max(int(conf), rows.count() // ROWS_OF_PART)
    sides = rows.repartition(parts, key).groupBy(key).agg(F.max("_side").alias("_new"), F.min("_side").alias("_old"))
    # A key that is NULL equals no other.
    alone = F.col(key).isNull() | (F.col("_new") == F.col("_old"))
    changes = F.array_compact(F.array(
        F.when(alone & (F.col("_new") == 1), "new"), F.when(alone & (F.col("_old") == 0), "deleted")))
    return sides.select(key, F.explode(changes).alias("change"))


def row_hash(columns: Sequence[str]) -> Column:
    """One hash per row: every value after its length, so that no two rows write the same text; NULL differs from all."""
    value = [F.col(c).cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in value]
    return F.md5(F.concat(*marked))


def changed_rows(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of both sides whose other columns differ, NULL-safe."""
    s = source.select(key, row_hash(columns).alias("_s"))
    t = target.select(key, row_hash(columns).alias("_t"))
    return s.join(t, key).filter(~F.col("_s").eqNullSafe(F.col("_t"))).select(key)


def profile(df: DataFrame) -> DataFrame:
    """Per column the non-NULL count, approximate distinct count, minimum and maximum, in one pass."""
    aggs = []
    for c in df.columns:
        col = F.col(c)
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(col).alias("non_null"),
            F.count_if(col.isNull()).alias("nulls"),
            F.approx_count_distinct(col).alias("approx_distinct"), F.min(col).cast("string").alias("min"),
            F.max(col).cast("string").alias("max")).alias(f"_{c}"))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{c}") for c in df.columns])))


def quality_counters(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Missing keys, negative amounts and keys that occur more than once."""
    flat = df.agg(
        F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(F.col(amount) < 0).alias("negative_amounts"))
    twice = not_unique(df, key).agg(F.count("*").alias("duplicate_keys"))
    return flat.join(twice, F.lit(True))


def validation_summary(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows, repeated rows, NULLs per column and values outside their range."""
    out = [F.count("*").alias("rows")]
    out += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns]
    out += [F.count_if(~F.col(c).between(lo, hi)).alias(f"{c}_out_of_range") for c, (lo, hi) in ranges.items()]
    distinct = df.distinct().agg(F.count("*").alias("_distinct"))
    return df.agg(*out).join(distinct, F.lit(True)).withColumn(
        "repeated_rows", F.col("rows") - F.col("_distinct")).drop("_distinct")
