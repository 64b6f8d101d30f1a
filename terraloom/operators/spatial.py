"""Spatial joins as tile-cover equi-joins: both sides name the tiles they touch, exact tests follow the hash join.

A pair that shares several tiles is kept in one: the tile that holds the lower left corner of the overlap. The
number of tiles a location covers is (width / tile + 1) squared, so choose tiles about as wide as the boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERCATOR_RADIUS = 6378137.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator x, y in metres."""
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_RADIUS


def tiles(df: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str, size: float) -> DataFrame:
    """df with a row for each tile (tx, ty) that its box touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return df.withColumn("tx", F.explode(span(xmin, xmax))).withColumn("ty", F.explode(span(ymin, ymax)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """points (px, py) in boxes (xmin, ymin, xmax, ymax), bounds included; a point lies in one tile, so no pair repeats."""
    placed = points.withColumn("tx", F.floor(F.col("px") / size)).withColumn("ty", F.floor(F.col("py") / size))
    inside = (F.col("px") >= F.col("xmin")) & (F.col("px") <= F.col("xmax")) & (F.col("py") >= F.col("ymin")) & (F.col("py") <= F.col("ymax"))
    return placed.join(tiles(boxes, "xmin", "ymin", "xmax", "ymax", size), ["tx", "ty"]).where(inside).drop("tx", "ty")


BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def touching_kinds(boxes: DataFrame, size: float) -> DataFrame:
    """Ordered pairs a_*, b_* of bounds that meet, each with itself too; boxes of the same bounds are one row here."""
    cover = tiles(boxes.select(*BOUNDS).distinct(), *BOUNDS, size)
    side = lambda p: cover.select("tx", "ty", *[F.col(c).alias(f"{p}_{c}") for c in BOUNDS])
    c = F.col
    meet = (c("a_xmin") <= c("b_xmax")) & (c("b_xmin") <= c("a_xmax")) & (c("a_ymin") <= c("b_ymax")) & (c("b_ymin") <= c("a_ymax"))
    once = (c("tx") == F.floor(F.greatest("a_xmin", "b_xmin") / size)) & (c("ty") == F.floor(F.greatest("a_ymin", "b_ymin") / size))
    return side("a").join(side("b"), ["tx", "ty"]).where(meet & once).drop("tx", "ty")


def members(pairs: DataFrame, boxes: DataFrame, side: str) -> DataFrame:
    """pairs with a row for each box that has the bounds of that side, its other columns as side_*; the boxes are the hashed side."""
    own = boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])
    return pairs.join(own.hint("shuffle_hash"), [f"{side}_{c}" for c in BOUNDS])


def touching_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """Pairs a_*, b_* of boxes (box_id, bounds) with a.box_id < b.box_id whose boxes meet."""
    found = members(members(touching_kinds(boxes, size), boxes, "a"), boxes, "b").where("a_box_id < b_box_id")
    return found.select(*[f"{p}_{c}" for p in "ab" for c in boxes.columns])


def related_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """(src, dst, rel) of all ordered pairs of boxes that meet, with box_relation of dst to src.

    Bounds are related before boxes are named. Of boxes of the same bounds that of the lesser box_id is covered (5), the other covers (4).
    """
    same = F.lit(True)
    for c in BOUNDS:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    kinds = touching_kinds(boxes, size).withColumn("rel", box_relation()).withColumn("same", same)
    boxes = boxes.select("box_id", *BOUNDS)
    first = members(kinds, boxes, "a").select("a_box_id", *[f"b_{c}" for c in BOUNDS], "rel", "same")
    named = members(first, boxes, "b").where("a_box_id <> b_box_id")
    rel = F.when(F.col("same") & (F.col("a_box_id") > F.col("b_box_id")) & (F.col("rel") == 5), 4).otherwise(F.col("rel"))
    return named.select(F.col("a_box_id").alias("src"), F.col("b_box_id").alias("dst"), rel.alias("rel"))


def corners_in_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """(box_id, n): lower left corners of boxes of another box_id inside; boxes without any are left out.

    Corners are counted by place and boxes by bounds before they meet; corners of the same box_id are taken off.
    """
    boxes = boxes.where("box_id IS NOT NULL").select("box_id", *BOUNDS)
    places = boxes.groupBy(F.col("xmin").alias("px"), F.col("ymin").alias("py")).agg(F.count("*").alias("n"))
    kinds = points_in_boxes(places, boxes.select(*BOUNDS).distinct(), size).groupBy(*BOUNDS).agg(F.sum("n").alias("n"))
    every = boxes.join(kinds, list(BOUNDS)).groupBy("box_id").agg(F.sum("n").alias("n"))
    corners = boxes.select("box_id", F.col("xmin").alias("px"), F.col("ymin").alias("py"))
    own = boxes.join(corners, "box_id").where("px >= xmin AND px <= xmax AND py >= ymin AND py <= ymax").groupBy("box_id").agg(F.count("*").alias("own"))
    left = F.col("n") - F.coalesce("own", F.lit(0))
    return every.join(own, "box_id", "left").select("box_id", left.alias("n")).where("n > 0")


def box_relation() -> Column:
    """Relation code of b to a for rectangles with inner area: 1 disjoint, 2 touches, 5 b covers a, 4 b is covered, 3 overlaps."""
    return F.expr("""CASE
  WHEN a_xmin > b_xmax OR b_xmin > a_xmax OR a_ymin > b_ymax OR b_ymin > a_ymax THEN 1
  WHEN a_xmin = b_xmax OR b_xmin = a_xmax OR a_ymin = b_ymax OR b_ymin = a_ymax THEN 2
  WHEN b_xmin <= a_xmin AND b_ymin <= a_ymin AND b_xmax >= a_xmax AND b_ymax >= a_ymax THEN 5
  WHEN a_xmin <= b_xmin AND a_ymin <= b_ymin AND a_xmax >= b_xmax AND a_ymax >= b_ymax THEN 4
  ELSE 3 END""")
