"""Radius joins of points and segments, binned into grid cells so that they are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import finite, segment_distance2

CELL = 64.0


def cell(x: Column, size: float = CELL) -> Column:
    return F.floor(x / size).cast("long")


def cells_touched(x: Column, y: Column, radius: Column, size: float = CELL) -> Column:
    """How many cells a query's box touches."""
    span = lambda v: cell(v + radius, size) - cell(v - radius, size) + 1
    return span(x) * span(y)


def _covered(queries: DataFrame, size: float) -> DataFrame:
    """queries(qid, qx, qy, radius), a row for each cell that the box of each touches."""
    r = F.col("radius")
    across = queries.withColumn("cx", F.explode(F.sequence(cell(F.col("qx") - r, size), cell(F.col("qx") + r, size))))
    return across.withColumn("cy", F.explode(F.sequence(cell(F.col("qy") - r, size), cell(F.col("qy") + r, size))))


def points_near(points: DataFrame, queries: DataFrame, size: float = CELL) -> DataFrame:
    """(qid, id, d2): points(id, x, y) within each query's radius, its edge included. A query and a point meet in the
    point's own cell only, so no pair comes twice."""
    placed = points.where(finite(F.col("x")) & finite(F.col("y"))).withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return _covered(queries, size).join(placed, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= F.col("radius") * F.col("radius")).select("qid", "id", "d2")


def segment_cells(segments: DataFrame, size: float = CELL) -> DataFrame:
    """segments(id, x1, y1, x2, y2), a row for each cell that a walk in half-cell steps visits."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    good = segments.where(finite(ends[0]) & finite(ends[1]) & finite(ends[2]) & finite(ends[3]))
    length = F.sqrt(F.pow(ends[2] - ends[0], F.lit(2.0)) + F.pow(ends[3] - ends[1], F.lit(2.0)))
    walk = good.withColumn("n", F.greatest(F.lit(1), F.ceil(length / (size / 2))).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    t = F.col("i") / F.col("n")
    return walk.withColumn("cx", cell(ends[0] + (ends[2] - ends[0]) * t, size)).withColumn("cy", cell(ends[1] + (ends[3] - ends[1]) * t, size)).drop("i", "n").dropDuplicates(["id", "cx", "cy"])


def segments_near(segments: DataFrame, queries: DataFrame, size: float = CELL) -> DataFrame:
    """(qid, id, d2): segments within each query's radius that share a visited cell with the query's box."""
    d2 = segment_distance2(F.col("qx"), F.col("qy"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = _covered(queries, size).join(segment_cells(segments, size), ["cx", "cy"]).withColumn("d2", d2)
    return met.where(F.col("d2") <= F.col("radius") * F.col("radius")).groupBy("qid", "id").agg(F.min("d2").alias("d2"))


def nearest(hits: DataFrame) -> DataFrame:
    """(qid, id, d2): each query's nearest hit, the first id among equals."""
    return hits.groupBy("qid").agg(F.min(F.struct("d2", "id")).alias("best")).select("qid", "best.id", "best.d2")


def node_hits(points: DataFrame, taps: DataFrame, scale: float, radius_px: float = 24.0) -> DataFrame:
    """The node nearest to each tap(qid, qx, qy) in world coordinates, within a radius of screen pixels."""
    return nearest(points_near(points, taps.withColumn("radius", F.lit(radius_px / scale))))


def edge_hits(segments: DataFrame, taps: DataFrame, scale: float, radius_px: float = 12.0) -> DataFrame:
    return nearest(segments_near(segments, taps.withColumn("radius", F.lit(radius_px / scale))))
