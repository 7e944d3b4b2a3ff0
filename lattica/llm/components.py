"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import discard, settled


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in links(u, v): the component is its smallest node.

    Neighbour minima are pre-aggregated, so a node with very many links is never gathered in one task. Self links
    and repeated links are allowed. Raises if the rounds run out, which a graph of under 2**30 nodes can't cause.
    """
    edges, seen = settled(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), None
    for _ in range(most_rounds):
        before, edges = edges, settled(_small_star(_large_star(edges)), "stars")
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._settled_path = edges._settled_path  # the caller may discard it
            return out
        seen = now
    raise RuntimeError("components did not settle")
