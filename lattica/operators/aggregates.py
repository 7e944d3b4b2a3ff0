"""Degrees, counts, normalisation, bounds and other aggregates of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import finite


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, neighbours): ends of edges at a node, a loop being two; and distinct other nodes it's joined to."""
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    found = ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_distinct(F.when(F.col("id") != F.col("other"), F.col("other"))).alias("neighbours"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b: the simple graph without directions, loops and parallels."""
    return edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def counts_by_kind(nodes: DataFrame, edges: DataFrame, upstream: list[str]) -> DataFrame:
    """(kind, n): nodes of each kind, 0 for upstream kinds without any, and the edges."""
    spark = nodes.sparkSession
    have = nodes.groupBy("kind").count()
    keys = spark.createDataFrame([(k,) for k in upstream], "kind string").union(have.select("kind")).distinct()
    per = keys.join(have, "kind", "left").select("kind", F.coalesce("count", F.lit(0)).alias("n"))
    return per.where("kind != 'edges'").union(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))


def normalized(scores: DataFrame) -> DataFrame:
    """(id, value, norm): values from 0 to 1 by least and greatest; where these are equal, 1 if positive, else 0."""
    sound = F.when(~F.isnan("value"), F.col("value"))
    ends = scores.agg(F.min(sound).alias("lo"), F.max(sound).alias("hi"))
    span = F.col("hi") - F.col("lo")
    norm = F.when(span > 0, (F.col("value") - F.col("lo")) / F.nullif(span, F.lit(0.0))).otherwise(F.when(F.col("hi") > 0, 1.0).otherwise(0.0))
    return scores.crossJoin(F.broadcast(ends)).select("id", "value", norm.alias("norm"))  # one row


def bounds(nodes: DataFrame) -> DataFrame:
    """One row (min_x, min_y, max_x, max_y, n) of the finite points; nulls without any."""
    good = nodes.where(finite(F.col("x")) & finite(F.col("y")))
    return good.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count("*").alias("n"))


def world_bounds(nodes: DataFrame) -> DataFrame:
    """bounds, or no row with fewer than two points or no width or height."""
    return bounds(nodes).where("n >= 2 and max_x > min_x and max_y > min_y")


def fitted_camera(nodes: DataFrame, width: float, height: float, dpr: float = 1.0) -> DataFrame:
    """One row (scale, pan_x, pan_y) that shows all finite points; no row without points or without a pane."""
    across, down = (F.greatest(F.lit(s - 112.0), F.lit(s * 0.5)) for s in (width, height))
    wide, high = F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0)), F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0))
    scale = F.least(F.lit(1.5), F.greatest(F.lit(0.02), F.least(across / wide, down / high)))
    some = bounds(nodes).where((F.col("n") > 0) & F.lit(width > 0 and height > 0))
    return some.select((scale * dpr).alias("scale"), ((F.col("min_x") + F.col("max_x")) / 2).alias("pan_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("pan_y"))


def map_projection(nodes: DataFrame, width: float = 148.0, height: float = 92.0, pad: float = 6.0) -> DataFrame:
    """One row of the world's bounds, the map's scale m and its offsets ox and oy: the map holds the world and keeps its
    shape. No row without bounds."""
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    shape = world_bounds(nodes).withColumn("m", F.least((width - 2 * pad) / wide, (height - 2 * pad) / high))
    return shape.withColumn("ox", (width - wide * F.col("m")) / 2).withColumn("oy", (height - high * F.col("m")) / 2)


def minimap(nodes: DataFrame, width: float = 148.0, height: float = 92.0, pad: float = 6.0) -> DataFrame:
    """(id, mx, my) of the finite points on the map; no rows without bounds."""
    good = nodes.where(finite(F.col("x")) & finite(F.col("y"))).crossJoin(F.broadcast(map_projection(nodes, width, height, pad)))  # one row
    return good.select("id", ((F.col("x") - F.col("min_x")) * F.col("m") + F.col("ox")).alias("mx"), ((F.col("y") - F.col("min_y")) * F.col("m") + F.col("oy")).alias("my"))


def map_jumps(nodes: DataFrame, presses: DataFrame, width: float = 148.0, height: float = 92.0, pad: float = 6.0) -> DataFrame:
    """(pid, x, y): the world point under each press(pid, mx, my) on the map, or the nearest edge of the world for one in
    the map's margin; no rows without bounds."""
    shaped = presses.crossJoin(F.broadcast(map_projection(nodes, width, height, pad)))  # one row
    world = lambda c: (F.col(f"m{c}") - F.col(f"o{c}")) / F.col("m") + F.col(f"min_{c}")
    inside = lambda c: F.least(F.col(f"max_{c}"), F.greatest(F.col(f"min_{c}"), world(c))).alias(c)
    return shaped.select("pid", inside("x"), inside("y"))


def minimap_view(shape: dict, view: dict, width: float = 148.0, height: float = 92.0) -> tuple[float, float, float, float]:
    """x, y, width and height on the map of what a camera shows: at least 6 by 4, cut one pixel outside the map."""
    scale = view["scale"] / (view.get("dpr") or 1)
    out = []
    for pan, extent, low, off, least, most in (("pan_x", "width", "min_x", "ox", 6.0, width), ("pan_y", "height", "min_y", "oy", 4.0, height)):
        half = view[extent] / scale / 2
        a, b = ((view[pan] + s * half - shape[low]) * shape["m"] + shape[off] for s in (-1, 1))
        if b - a < least:
            a, b = (a + b) / 2 - least / 2, (a + b) / 2 + least / 2
        start = max(-1.0, a)
        out.append((start, min(most + 1, b) - start))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def path_totals(total):
    """The compounded rate of a path's total cost."""
    return F.exp(-total)
