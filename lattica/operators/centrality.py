"""Eigenvector centrality by distributed power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import centrality_weight
from lattica.sources.graphs import Graph
from lattica.sources.shared import cut


def eigenvector_centrality(graph: Graph, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node_id, value): power iteration on the adjacency plus identity, directions ignored, scaled so that the greatest
    is 1. Loops and edges with unknown ends don't count; without edges all values are 0. Ids must be unique."""
    ids = graph.nodes.select("id")
    edges = graph.edges.where("source != target").select("source", "target", centrality_weight(F.col("weight")).alias("w"))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    both = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    both = cut(both.groupBy("source", "target").agg(F.sum("w").alias("w")), "adjacency")  # pre-aggregated once
    if both.isEmpty():
        return ids.select(F.col("id").alias("node_id"), F.lit(0.0).alias("value"))
    n = ids.count()
    x = cut(ids.select(F.col("id").alias("node"), F.lit(n**-0.5).alias("v")), "vector")
    for _ in range(rounds):
        given = both.join(x, both.source == x.node).groupBy("target").agg(F.sum(F.col("w") * F.col("v")).alias("given"))
        raw = cut(x.join(given.withColumnRenamed("target", "node"), "node", "left").select("node", "v", (F.col("v") + F.coalesce("given", F.lit(0.0))).alias("raw")), "raw")
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")).first()["norm"]
        x = raw.select("node", (F.col("raw") / norm).alias("v"))
        change = raw.agg(F.sqrt(F.sum(F.pow(F.col("raw") / norm - F.col("v"), F.lit(2.0)))).alias("c")).first()["c"]
        if change < tolerance:
            break
    most = x.agg(F.max("v").alias("most")).first()["most"]
    return x.select(F.col("node").alias("node_id"), (F.col("v") / most if most > 0 else F.lit(0.0)).alias("value"))
