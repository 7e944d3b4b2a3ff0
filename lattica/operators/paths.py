"""Cheapest routes and losing cycles by bulk-synchronous relaxation.

Each round joins the frontier's distances with edges and keeps the cheapest predecessor of each target; the loop ends at
the first round that improves nothing. Lineage is cut in the shared folder at every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.graphs import Graph
from lattica.sources.shared import cut

#: A cycle is losing if its total is below minus this.
TOLERANCE = 1e-9


def distances(graph: Graph, source: str, ghosts: bool = False) -> DataFrame:
    """(node, dist, hops, prev, ord) of the nodes that can be reached from source over edges(source, target, weight,
    ord). Ties go to fewer hops, then to the earlier edge. Edges to undeclared nodes count only with ghosts."""
    edges = graph.edges.where("weight is not null").select(F.col("source").alias("node"), "target", "weight", "ord")
    if not ghosts:
        edges = edges.join(graph.nodes.select("id").withColumnRenamed("id", "target"), "target", "left_semi")
    edges = cut(edges, "edges")
    start = graph.nodes.where(F.col("id") == source).select(F.col("id").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("prev"), F.lit(None).cast("long").alias("ord"))
    best = cut(start, "dist")
    frontier = best
    for _ in range(max(0, graph.nodes.count() - 1)):
        step = frontier.join(edges.withColumnRenamed("ord", "via"), "node")
        way = F.struct((F.col("dist") + F.col("weight")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("via").alias("ord"), F.col("node").alias("prev"))
        offers = step.groupBy("target").agg(F.min(way).alias("way")).select(F.col("target").alias("node"), "way.*")
        old = best.select("node", F.col("dist").alias("old"))
        better = cut(offers.join(old, "node", "left").where("old is null or dist < old").select("node", "dist", "hops", "prev", "ord"), "better")
        if better.isEmpty():
            break
        best = cut(best.join(better.select("node"), "node", "left_anti").unionByName(better), "dist")
        frontier = better
    return best


def route(graph: Graph, source: str, target: str, ghosts: bool = False) -> DataFrame:
    """At most one row (nodes, total_weight, compounded_rate, hops): the cheapest path, none if either end is unknown or
    the target can't be reached, nor where predecessors run in a circle."""
    spark = graph.nodes.sparkSession
    schema = "nodes array<string>, total_weight double, compounded_rate double, hops int"
    ends = {r["id"] for r in graph.nodes.where(F.col("id").isin([source, target])).select("id").collect()}
    if {source, target} - ends:
        return spark.createDataFrame([], schema)
    found = cut(distances(graph, source, ghosts), "routes")
    walk, seen, total = [target], {target}, None
    while walk[-1] != source:  # one keyed lookup for each hop
        row = found.where(F.col("node") == walk[-1]).select("prev", "dist").first()
        if row is None or row["prev"] is None or row["prev"] in seen:
            return spark.createDataFrame([], schema)
        total = row["dist"] if total is None else total
        seen.add(row["prev"])
        walk.append(row["prev"])
    out = spark.createDataFrame([(walk[::-1], float(total or 0.0), len(walk) - 1)], "nodes array<string>, total_weight double, hops int")
    return out.select("nodes", "total_weight", F.exp(-F.col("total_weight")).alias("compounded_rate"), "hops")


def canonical_cycle(nodes: Column) -> Column:
    """A cycle's nodes from its least one on, closed: rotations of one cycle are equal."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    turned = F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))
    return F.concat(turned, F.slice(turned, 1, 1))


def negative_cycles(graph: Graph, longest: int = 4) -> DataFrame:
    """(nodes, total_weight, gain) of the simple cycles of up to `longest` edges whose total is negative. Paths grow from
    a cycle's least node only, so that each cycle is found once; parallel edges count by their cheapest."""
    ids = graph.nodes.select("id")
    edges = graph.edges.where("weight is not null and source != target").groupBy("source", "target").agg(F.min("weight").alias("weight"))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    edges = cut(edges, "edges")
    step = edges.select(F.col("source").alias("last"), F.col("target").alias("next"), F.col("weight").alias("w"))
    paths = edges.where("source < target").select(F.array("source", "target").alias("path"), F.col("target").alias("last"), F.col("weight").alias("total"))
    found = None
    for size in range(2, longest + 1):
        closing = paths.join(step, "last").where(F.col("next") == F.col("path")[0]).select(F.concat("path", F.array("next")).alias("nodes"), (F.col("total") + F.col("w")).alias("total_weight"))
        found = closing if found is None else found.unionByName(closing)
        if size < longest:
            grown = paths.join(step, "last").where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
            paths = cut(grown.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"), (F.col("total") + F.col("w")).alias("total")), "paths")
    lost = found.where(F.col("total_weight") < -TOLERANCE)
    return lost.select("nodes", "total_weight", F.exp(-F.col("total_weight")).alias("gain"))


def losing_cycle(graph: Graph, loops: bool = False) -> DataFrame:
    """(nodes, total_weight, gain) of one losing cycle of any length, or no row if there is none: all nodes start at 0,
    and predecessors are kept. If a round still improves after as many as nodes, walking them back from any node that it
    improved ends in a losing cycle. Self-loops count only with loops."""
    spark, schema = graph.nodes.sparkSession, "nodes array<string>, total_weight double"
    ids = graph.nodes.select("id").distinct()
    edges = graph.edges.where("weight is not null").where(F.lit(loops) | F.expr("source != target")).groupBy("source", "target").agg(F.min("weight").alias("weight"))
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    edges = cut(edges.withColumnRenamed("source", "node"), "edges")
    best = cut(ids.select(F.col("id").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("prev"), F.lit(None).cast("double").alias("via")), "dist")
    better = best
    for _ in range(best.count()):
        step = better.select("node", "dist").join(edges, "node")
        way = F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("node").alias("prev"), F.col("weight").alias("via"))
        offers = step.groupBy("target").agg(F.min(way).alias("way")).select(F.col("target").alias("node"), "way.*")
        old = best.select("node", F.col("dist").alias("old"))
        better = cut(offers.join(old, "node").where(F.col("dist") < F.col("old") - TOLERANCE).drop("old"), "better")
        if better.isEmpty():
            break
        best = cut(best.join(better.select("node"), "node", "left_anti").unionByName(better), "dist")
    last = better.agg(F.min("node").alias("node")).first()["node"]
    if last is None:
        return spark.createDataFrame([], schema).withColumn("gain", F.lit(0.0))
    walk, via = [last], []
    while walk[-1] not in walk[:-1]:  # one keyed lookup for each hop
        row = best.where(F.col("node") == walk[-1]).select("prev", "via").first()
        walk.append(row["prev"])
        via.append(row["via"])
    first = walk.index(walk[-1])
    found = spark.createDataFrame([(walk[:first:-1], sum(via[first:]))], schema)
    return found.select(canonical_cycle(F.col("nodes")).alias("nodes"), "total_weight", F.exp(-F.col("total_weight")).alias("gain"))


def losing_cycles(graph: Graph, longest: int = 4) -> DataFrame:
    """negative_cycles, and a losing cycle of more than `longest` edges where losing_cycle meets one: rows wherever any
    cycle is losing."""
    return negative_cycles(graph, longest).unionByName(losing_cycle(graph).where(F.size("nodes") > longest + 1))


def has_negative_cycle(graph: Graph) -> bool:
    """Whether any cycle at all is losing, self-loops included."""
    return not losing_cycle(graph, loops=True).isEmpty()
