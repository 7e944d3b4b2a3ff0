"""Differences between payload versions, and the state that survives them: positions, overrides and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.scalars import finite


def removed_ids(current: DataFrame, new: DataFrame) -> DataFrame:
    """(id) in current and not in new, compared as strings."""
    key = F.col("id").cast("string").alias("id")
    return current.select(key).join(new.select(key), "id", "left_anti")


def element_diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """(id, op): "remove" what is gone; "upsert" everything that is there now."""
    key = F.col("id").cast("string").alias("id")
    return removed_ids(current, new).withColumn("op", F.lit("remove")).unionByName(new.select(key).withColumn("op", F.lit("upsert")))


def applied(current: DataFrame, diff: DataFrame, new: DataFrame) -> DataFrame:
    """The element table after a diff; it equals new, but for fields that new leaves out."""
    gone = diff.where("op = 'remove'").select("id")
    kept = current.join(gone, "id", "left_anti").join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merged_positions(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """nodes with live positions where there are any, else their own."""
    b = live.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return nodes.join(b, "id", "left").withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y")).drop("_x", "_y")


def stored_positions(store: DataFrame, new: DataFrame) -> DataFrame:
    """A position store after an upsert: the latest position of each ref; nothing is evicted."""
    return store.join(new.select("ref"), "ref", "left_anti").unionByName(new.select("ref", "x", "y"))


def overridden(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """nodes with dragged positions in place of their own; overrides of absent nodes wait."""
    return merged_positions(nodes, overrides.where(finite(F.col("x")) & finite(F.col("y"))))


def incident_edges(edges: DataFrame) -> DataFrame:
    """(ref, edge_id): each edge at both its ends, once for a loop."""
    return edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("source", "target"))).alias("ref")).select("ref", "edge_id")


def edges_of_selection(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """(edge_id) of the edges at any selected node."""
    return incident_edges(edges).join(selection.select(F.col("id").alias("ref")), "ref", "left_semi").select("edge_id").distinct()


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids in exactly one of the two."""
    a, b = selection.select("id").distinct(), ids.select("id").distinct()
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))


def selection_flips(before: DataFrame, now: DataFrame) -> DataFrame:
    """(id, selected) of the ids whose selection changed."""
    a, b = before.select("id", F.lit(True).alias("a")).distinct(), now.select("id", F.lit(True).alias("b")).distinct()
    return a.join(b, "id", "full_outer").where("a is null or b is null").select("id", F.col("b").isNotNull().alias("selected"))


def edge_flips(before: DataFrame, now: DataFrame, base: DataFrame, color: str = "#e87044", width: float = 2.5) -> DataFrame:
    """selection_flips for edges, with the salient style for those selected and base(id, color, width) for the others."""
    flips = selection_flips(before, now).join(base.select("id", F.col("color").alias("_c"), F.col("width").alias("_w")), "id", "left")
    return flips.select("id", "selected", F.when(F.col("selected"), color).otherwise(F.col("_c")).alias("color"), F.when(F.col("selected"), width).otherwise(F.col("_w")).alias("width"))


def edge_geometry(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, x1, y1, x2, y2) of edges with both ends placed."""
    good = positions.where(finite(F.col("x")) & finite(F.col("y")))
    a = good.select(F.col("id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = good.select(F.col("id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.select("id", "source", "target").join(a, "source").join(b, "target").select("id", "x1", "y1", "x2", "y2")


class Session:
    """A consumer of payload versions: checks each, hands a sink what changed, and keeps drags across versions."""

    def __init__(self, sink):
        self._sink, self._ended, self.ingests = sink, False, 0
        self._overrides: dict[str, tuple[float, float]] = {}

    @property
    def status(self) -> str:
        return "destroyed" if self._ended else "ready" if self.ingests else "idle"

    def ingest(self, nodes: DataFrame, edges: DataFrame, tier: str) -> None:
        from lattica.operators.validate import PayloadError, gate, rescan

        if self._ended:
            raise PayloadError("lifecycle", "ingest after destroy")
        gate(nodes, tier)
        rescan(nodes)
        gone_edges = removed_ids(self._sink.edges(), edges)
        gone_nodes = removed_ids(self._sink.nodes(), nodes)
        self._sink.remove(gone_nodes, gone_edges)
        self._sink.upsert(overridden(nodes, self.overrides(nodes.sparkSession)), edges)
        self.ingests += 1

    def override(self, ref: str, x: float, y: float) -> bool:
        """Pins a node where it was dragged to; false for a position that isn't finite."""
        if not (abs(x) < float("inf") and abs(y) < float("inf")):
            return False
        self._overrides[ref] = (x, y)
        self._sink.pin(ref)
        self._sink.set_positions(self._sink.nodes().sparkSession.createDataFrame([(ref, x, y)], "id string, x double, y double"))
        return True

    def overrides(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, *v) for k, v in self._overrides.items()], "id string, x double, y double")

    def clear_overrides(self, served: DataFrame) -> None:
        """Unpins everything, and puts nodes back where served(id, x, y) has them."""
        for ref in self._overrides:
            self._sink.unpin(ref)
        self._sink.set_positions(served.join(self.overrides(served.sparkSession).select("id"), "id", "left_semi"))
        self._overrides.clear()

    def destroy(self) -> None:
        self._ended = True
