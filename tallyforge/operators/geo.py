"""Points, radius joins, polygons and grid cells.

Distances are on a sphere of the mean earth radius; against the ellipsoid they
are off by up to about 0.5 %.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.operators.ranking import with_rank
from tallyforge.session import cut, spread
from tallyforge.settings import Settings

# Fixed value: mean earth radius in metres.
EARTH_RADIUS = 6_371_008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS / 180


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """K18. Great-circle distance in metres of points in degrees."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within_radius(
    left: DataFrame, right: DataFrame, metres: float, max_abs_lat: float = 80.0
) -> DataFrame:
    """K18. Pairs (l_id, r_id, metres) at most ``metres`` apart, by an equi-join on grid cells.

    Both sides are (id, lat, lng). Cells are half of ``metres`` high and, in each
    row of cells, about as wide (up to ``max_abs_lat``); a right point is copied
    to the cells that its circle can touch. Few points can have many pairs, so
    the cells are dealt over a fixed number of parts. Longitudes do not wrap at
    180 degrees.
    """
    reach = metres / METRES_PER_DEGREE * (1 + 1e-9)
    high = reach / 2
    row = lambda lat: F.floor(lat / high)
    top = lambda cy: F.least(F.greatest(F.abs(cy), F.abs(cy + 1)) * high, F.lit(max_abs_lat))
    wide = lambda cy: F.lit(high) / F.cos(F.radians(top(cy)))
    # A path of this length crosses no more degrees than it would where the circle is nearest to a pole.
    tip = F.abs("r_lat") + reach
    side = F.when(tip < 89.9, reach / F.cos(F.radians(tip)) * (1 + 1e-9)).otherwise(360.0)
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    a = spread(left).select(
        F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lng").alias("l_lng"),
        row(F.col("lat")).alias("cy")).withColumn("cx", F.floor(F.col("l_lng") / wide(F.col("cy"))))
    b = right.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng")).withColumn(
        "side", side).withColumn("cy", F.explode(F.sequence(row(F.col("r_lat") - reach), row(F.col("r_lat") + reach)))).withColumn(
        "cx", F.explode(F.sequence(
            F.floor((F.col("r_lng") - F.col("side")) / wide(F.col("cy"))), F.floor((F.col("r_lng") + F.col("side")) / wide(F.col("cy"))))))
    far = haversine(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"))
    boxed = (F.abs(F.col("l_lat") - F.col("r_lat")) <= reach) & (F.abs(F.col("l_lng") - F.col("r_lng")) <= F.col("side"))
    met = a.repartition(parts, "cy", "cx").join(b.repartition(parts, "cy", "cx").hint("shuffle_hash"), ["cy", "cx"]).filter(boxed)
    return met.withColumn("metres", far).filter(F.col("metres") <= metres).select("l_id", "r_id", "metres")


#: Targets that one searched list holds, about.
LISTED = 4096


def fitting_cell(targets: DataFrame, cell: float, k: int) -> tuple[float, int]:
    """``cell`` halved until its fullest square would hold about ``k`` of (rx, ry), if they lay evenly in it; and their number."""
    counts = targets.groupBy(F.floor(F.col("rx") / cell), F.floor(F.col("ry") / cell)).agg(F.count("*").alias("n"))
    most, total = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    while most > k:
        cell, most = cell / 2, most / 4
    return cell, total


def nearest(left: DataFrame, right: DataFrame, k: int, cell: float, settings: Settings = Settings()) -> DataFrame:
    """D67. The ``k`` nearest right points per left point in the plane: (l_id, r_id, distance, rank).

    Both sides are (id, x, y). The search looks at the square of cells around a
    point and doubles it until the k-th hit lies inside it, so the result is
    exact. ``cell`` is where the size begins at most: it is halved first to suit
    how densely the right points lie. Each cell has one list of the right points
    in and around it, cut into parts if it is long, and a point picks its best
    from the list, so pairs are never rows. Alike points are searched once, and
    of right points on one spot only the first k by id can be hits. Points
    without finite coordinates take no part.
    """
    finite = lambda x, y: (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))
    spots = left.filter(finite("x", "y")).groupBy("x", "y").agg(F.count("*").alias("n")).select("x", "y")
    targets = cut(
        with_rank(right.filter(finite("x", "y")).select(F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry")),
                  ["rx", "ry"], ["r_id"], "_n", settings).filter(F.col("_n") <= k).drop("_n"), "targets")
    size, total = fitting_cell(targets, cell, k)
    open_spots, done = cut(spots, "spots"), None
    while True:
        at = lambda c: F.floor(F.col(c) / size)
        around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
        copied = targets.withColumn("cx", around("rx")).withColumn("cy", around("ry"))
        longest = copied.groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        parts = longest // LISTED + 1
        lists = copied.groupBy("cx", "cy", F.pmod(F.xxhash64("r_id"), F.lit(parts)).alias("part")).agg(
            F.collect_list(F.struct("rx", "ry", "r_id")).alias("list")).drop("part")
        away = lambda t: F.sqrt(F.pow(t["rx"] - F.col("x"), 2) + F.pow(t["ry"] - F.col("y"), 2))
        best = lambda hits: F.slice(F.sort_array(hits), 1, k)
        hits = open_spots.withColumns({"cx": at("x"), "cy": at("y")}).join(lists, ["cx", "cy"], "left").select(
            "x", "y", best(F.transform("list", lambda t: F.struct(away(t).alias("distance"), t["r_id"].alias("r_id")))).alias("hits"))
        if parts > 1:
            hits = hits.groupBy("x", "y").agg(best(F.flatten(F.collect_list("hits"))).alias("hits"))
        # Everything outside the square is further away than one cell.
        inside = (F.size("hits") >= min(k, total)) & (F.get("hits", F.size("hits") - 1)["distance"] <= size)
        ring = cut(hits.withColumn("settled", F.coalesce(inside, F.lit(False))), "ring")
        settled = ring.filter("settled").select("x", "y", "hits")
        done = settled if done is None else done.unionByName(settled)
        open_spots = ring.filter("not settled").select("x", "y")
        if total == 0 or open_spots.isEmpty():
            break
        size *= 2  # same number of cells, twice the reach
    return left.select(F.col("id").alias("l_id"), "x", "y").join(done, ["x", "y"]).select(
        "l_id", F.posexplode("hits").alias("rank", "hit")).select(
        "l_id", "hit.r_id", "hit.distance", (F.col("rank") + 1).alias("rank"))


def in_box(lng: Column, lat: Column, box: Sequence[float]) -> Column:
    """K19. (west, south, east, north)."""
    west, south, east, north = box
    return lng.between(west, east) & lat.between(south, north)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """K19. Even-odd rule over an array of struct(x, y) vertices, the last joined to the first."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"),
        F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))
    crossing = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(None)).otherwise(e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """K19. (id, x, y) x (polygon_id, ring) -> (id, polygon_id): cells of the bounding box first, then the rule."""
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    cells = lambda a: F.explode(F.sequence(F.floor(F.array_min(a) / cell), F.floor(F.array_max(a) / cell)))
    boxed = polygons.withColumn("cx", cells(xs)).withColumn("cy", cells(ys))
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return at.join(boxed, ["cx", "cy"]).filter(in_polygon(F.col("x"), F.col("y"), F.col("ring"))).select(
        "id", "polygon_id")


def cell_counts(points: DataFrame, size: float) -> DataFrame:
    """K20. Points per square grid cell."""
    return points.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(
        F.count("*").alias("n"))
