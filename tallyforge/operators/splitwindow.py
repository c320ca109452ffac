"""Ordered windows over groups of any length.

The rows are range-partitioned by (group, order), so a long group lies in many
consecutive parts. A window runs inside each part, and one small row per
(group, part) carries what the next part needs: the last row (lag, forward
fill) or the total so far (running sums).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.operators.ranking import join_parts, part_sums, range_split


class OrderedParts:
    """``df`` ordered by (group, order); ``order`` must be unique inside a group."""

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str]):
        self.group, self.order = list(group), list(order)
        self.rows = range_split(df, group, order)
        self._inside = Window.partitionBy(*group, "_part").orderBy(*order)
        self._parts = Window.partitionBy(*group).orderBy("_part")

    def _last_of_part(self, c: Column, name: str, only: Column | None = None) -> DataFrame:
        rows = self.rows if only is None else self.rows.filter(only)
        return rows.groupBy(*self.group, "_part").agg(
            F.max_by(F.struct(c.alias("v")), F.struct(*self.order)).alias(name))

    def _carried(self, c: Column, name: str, only: Column | None = None) -> DataFrame:
        """Per (group, part): the last value of the nearest earlier part that has one."""
        every = self.rows.select(*self.group, "_part").distinct()
        last = self._last_of_part(c, name, only)
        w = self._parts.rowsBetween(Window.unboundedPreceding, -1)
        joined = join_parts(every, last, self.group)
        return joined.select(*self.group, "_part", F.last(name, ignorenulls=True).over(w).alias(name))

    def lag(self, out: str, c: Column) -> "OrderedParts":
        """Value of ``c`` in the row before."""
        carried = self._carried(c, "_carry")
        inside = self.rows.withColumns({
            "_lag": F.lag(F.struct(c.alias("v"))).over(self._inside)})
        self.rows = join_parts(inside, carried, self.group).withColumn(
            out, F.coalesce("_lag", "_carry")["v"]).drop("_lag", "_carry")
        return self

    def forward_fill(self, out: str, c: Column) -> "OrderedParts":
        """Last non-NULL value of ``c`` up to and including the row."""
        carried = self._carried(c, "_carry", c.isNotNull())
        inside = self.rows.withColumn("_fill", F.last(c, ignorenulls=True).over(
            self._inside.rowsBetween(Window.unboundedPreceding, 0)))
        self.rows = join_parts(inside, carried, self.group).withColumn(
            out, F.coalesce(F.col("_fill"), F.col("_carry")["v"])).drop("_fill", "_carry")
        return self

    def running_sum(self, out: str, c: Column) -> "OrderedParts":
        before = part_sums(self.rows, self.group, _before=F.sum(c))
        inside = self.rows.withColumn("_inside", F.sum(c).over(
            self._inside.rowsBetween(Window.unboundedPreceding, 0)))
        self.rows = join_parts(inside, before, self.group).withColumn(
            out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("_part")


def sessions(
    df: DataFrame, group: Sequence[str], ts: str, tie: str, gap_seconds: int, out: str = "session_no"
) -> DataFrame:
    """Number sessions: a new one starts after more than ``gap_seconds`` without a row."""
    parts = OrderedParts(df, group, [ts, tie]).lag("_previous", F.col(ts))
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    fresh = F.col("_previous").isNull() | (
        seconds(F.col(ts)) - seconds(F.col("_previous")) > gap_seconds * 1_000_000)
    parts.rows = parts.rows.withColumn("_fresh", fresh.cast("long"))
    return parts.running_sum(out, F.col("_fresh")).result().drop("_previous", "_fresh")
