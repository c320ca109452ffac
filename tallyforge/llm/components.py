"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.session import cut


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; two nodes share a root exactly when a path joins them.

    Every round maps a node to the smallest of itself and its neighbours, in the order of a hash, and keeps the links
    between the images. Neighbours have linked images, so components neither merge nor split, and a component that has
    links loses at least its largest node. The rounds end when no link is left; nothing is collected but that one bit.
    Self links and repeated links are allowed. No links: no rows.
    """
    links = cut(links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct(), "links")
    label = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        least = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))),
                        F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id")))
        up = cut(both.groupBy("a").agg(least["id"].alias("up")).withColumnRenamed("a", "node"), "contract")
        if label is None:
            label = up.withColumnRenamed("up", "root")
        else:
            label = cut(label.join(up, label["root"] == up["node"], "left").select(
                label["node"], F.coalesce("up", "root").alias("root")), "labels")
        ends = links.join(up, F.col("a") == F.col("node")).select("b", F.col("up").alias("a"))
        ends = ends.join(up, F.col("b") == F.col("node")).select("a", F.col("up").alias("b")).filter("a <> b")
        links = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if label is None else label
