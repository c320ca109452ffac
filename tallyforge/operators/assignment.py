"""G1: greedy one-to-one assignment of settlements to orders without a driver loop over rows.

The rule is sequential: visit settlements by (date, id); each takes the first
free order, by (ledger sequence, id), that it may be matched with. Two
distributed forms give the same pairs:

* ``fold_by_key``: when all edges of a settlement stay inside one key and the
  key is small, the edges of a key are sorted and folded inside one row, in the
  JVM and without iterating.
* ``assign_in_rounds``: for keys of any size and for edges that cross keys.
  Rows with the same possible partners form one class, so a key shared by
  millions of alike rows has few class pairs, and pairs of rows are never
  listed. In each round every settlement class advances as far as no rival
  class could get in before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut
from tallyforge.settings import Settings

EDGE = ["phase", "s_pos", "o_pos", "label"]


def fold_by_key(edges: DataFrame) -> DataFrame:
    """Edges (key, phase, s_pos, o_pos, label) -> accepted (s_pos, o_pos, label).

    ``s_pos`` and ``o_pos`` are structs ending in the record id, so they are
    both the visiting order and the identity. A lower phase is run to its end
    before a higher one starts.
    """
    grouped = edges.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(*EDGE))).alias("es")
    )
    empty = F.slice("es", 1, 0)
    folded = F.aggregate(
        "es",
        empty,
        lambda taken, e: F.when(
            F.exists(taken, lambda t: (t["s_pos"] == e["s_pos"]) | (t["o_pos"] == e["o_pos"])), taken
        ).otherwise(F.concat(taken, F.array(e))),
    )
    picked = F.when(F.size("es") == 1, F.col("es")).otherwise(folded)
    return grouped.select(F.explode(picked).alias("e")).select("e.s_pos", "e.o_pos", "e.label")


def hot_keys(settlements: DataFrame, orders: DataFrame, settings: Settings) -> DataFrame:
    """Keys whose settlement x order product is above the limit of the per-key fold."""
    s = settlements.groupBy("key").agg(F.count("*").alias("n_s"))
    o = orders.groupBy("key").agg(F.count("*").alias("n_o"))
    pairs = s.join(o, "key").filter(F.col("n_s") * F.col("n_o") > settings.hot_key_pairs)
    return pairs.select("key")


def near_classes(
    s_classes: DataFrame,
    o_classes: DataFrame,
    on: Sequence[str],
    arms: Sequence[tuple[Column, Column]],
    width: int,
    accept: Column,
    date_arm: tuple[Column, Column, int] | None = None,
) -> DataFrame:
    """Pairs (a, b) of classes that ``accept``, found through amount (and date) cells.

    Each arm names an amount of either side; a pair is possible when the two
    lie within ``width``. Order classes are copied to the at most two cells
    their range touches, settlement classes sit in one.
    """
    cell = 2 * width + 1

    def spread(low: Column, high: Column, size: int) -> Column:
        return F.array_distinct(F.array(F.floor(low / size), F.floor(high / size)))

    found = None
    for s_amount, o_amount in arms:
        s = s_classes.withColumn("_cell", F.floor(s_amount / cell))
        o = o_classes.withColumn("_cell", F.explode(spread(o_amount - width, o_amount + width, cell)))
        keys = [*on, "_cell"]
        if date_arm:
            s_day, o_day, days = date_arm
            size = 2 * days + 1
            s = s.withColumn("_day", F.floor(s_day / size))
            o = o.withColumn("_day", F.explode(spread(o_day - days, o_day + days, size)))
            keys.append("_day")
        pairs = s.join(o, keys).filter(accept).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def merge_alike(class_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes with the same partners become one; gives (edges, a -> a2, b -> b2)."""

    def renamed(edges: DataFrame, side: str, other: str) -> DataFrame:
        return edges.groupBy(side).agg(
            F.sha2(F.to_json(F.sort_array(F.collect_set(other))), 256).alias(f"{side}2")
        )

    b_names = cut(renamed(class_edges, "b", "a"), "merge-b")
    by_b = class_edges.join(b_names, "b").select("a", F.col("b2").alias("b")).distinct()
    a_names = cut(renamed(by_b, "a", "b"), "merge-a")
    merged = by_b.join(a_names, "a").select(F.col("a2").alias("a"), "b").distinct()
    return cut(merged, "class-edges"), a_names, b_names


def _zip_stars(
    s_members: DataFrame, o_members: DataFrame, class_edges: DataFrame, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Stars need no rounds: around one hub class, everybody else has no other partner.

    Their settlements and orders are each put in order and zipped. Returns the
    (s_pos, o_pos) pairs and the class edges that are left; with near-unique
    references nothing is.
    """
    degree_a = class_edges.groupBy("a").agg(F.count("*").alias("n_a"))
    edges = class_edges.join(degree_a, "a")
    per_b = edges.groupBy("b").agg(F.count("*").alias("n_b"), (F.max("n_a") == 1).alias("b_hub"))
    edges = edges.join(per_b, "b")
    per_a = edges.groupBy("a").agg((F.max("n_b") == 1).alias("a_hub"))
    hub = F.when(F.col("b_hub"), F.concat(F.lit("b"), F.col("b"))).when(
        F.col("a_hub"), F.concat(F.lit("a"), F.col("a")))
    edges = cut(edges.join(per_a, "a").select("a", "b", hub.alias("hub")), "stars")
    star = edges.filter("hub is not null")
    s = s_members.join(star.select("a", "hub").distinct(), "a").select("hub", "s_pos")
    o = o_members.join(star.select("b", "hub").distinct(), "b").select("hub", "o_pos")
    pairs = cut(
        with_rank(s, ["hub"], ["s_pos"], "i", settings)
        .join(with_rank(o, ["hub"], ["o_pos"], "i", settings), ["hub", "i"])
        .select("s_pos", "o_pos"),
        "star-pairs",
    )
    return pairs, edges.filter("hub is null").select("a", "b")


def assign_in_rounds(
    s_members: DataFrame, o_members: DataFrame, class_edges: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """(a, s_pos), (b, o_pos), (a, b) -> (s_pos, o_pos) of the sequential rule.

    Round: let ``bound`` of a settlement class be the first free settlement of
    any other class that shares an order class with it. Its members before the
    bound cannot lose an order to anybody, so the i-th of them takes the i-th
    free order of its order classes. The class holding the very first free
    settlement always advances, so every round makes progress.
    """
    pairs, tangled = _zip_stars(s_members, o_members, class_edges, settings)
    if tangled.isEmpty():
        return pairs
    edges, a_names, b_names = merge_alike(tangled)
    s_free = cut(s_members.join(a_names, "a").select(F.col("a2").alias("a"), "s_pos"), "free-s")
    o_free = cut(o_members.join(b_names, "b").select(F.col("b2").alias("b"), "o_pos"), "free-o")
    while True:
        heads = s_free.groupBy("a").agg(F.min("s_pos").alias("head"))
        live = cut(
            edges.join(heads, "a").join(o_free.select("b").distinct(), "b", "left_semi"), "live-edges"
        )
        if live.isEmpty():
            break
        first = live.groupBy("b").agg(F.min(F.struct("head", "a")).alias("first"))
        rivals = live.join(first, "b")
        second = (
            rivals.filter(F.col("a") != F.col("first.a"))
            .groupBy("b")
            .agg(F.min("head").alias("second"))
        )
        # Only the class with the first head of b can advance on b; its bound is
        # the second head. Any other class of b is bounded by the first head.
        bounds = (
            rivals.join(second, "b", "left")
            .groupBy("a")
            .agg(
                F.min(
                    F.when(F.col("a") == F.col("first.a"), F.col("second")).otherwise(F.col("first.head"))
                ).alias("bound"),
                F.min("head").alias("head"),
            )
            .filter(F.col("bound").isNull() | (F.col("head") < F.col("bound")))
            .select("a", "bound")
        )
        bounds = cut(bounds, "bounds")
        movers = cut(
            s_free.join(bounds, "a")
            .filter(F.col("bound").isNull() | (F.col("s_pos") < F.col("bound")))
            .select("a", "s_pos"),
            "movers",
        )
        offered = cut(
            o_free.join(live.join(bounds, "a", "left_semi").select("a", "b"), "b").select("a", "o_pos"),
            "offered",
        )
        new = cut(
            with_rank(movers, ["a"], ["s_pos"], "i", settings)
            .join(with_rank(offered, ["a"], ["o_pos"], "i", settings), ["a", "i"])
            .select("s_pos", "o_pos"),
            "round",
        )
        pairs = pairs.unionByName(new)
        # Movers left without an order find none later either: free orders only shrink.
        live_a = live.select("a").distinct()
        s_free = cut(
            s_free.join(movers.select("s_pos"), "s_pos", "left_anti").join(live_a, "a", "left_semi"), "free-s"
        )
        o_free = cut(o_free.join(new.select("o_pos"), "o_pos", "left_anti"), "free-o")
    return pairs
