"""Keyed sinks that take upserts and removals, and never a whole new state."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import finite
from lattica.sources.shared import cut


class SinkError(RuntimeError):
    """A sink that can't be built or used as asked."""


class GraphSink(ABC):
    """What an incremental consumer offers: upserts, removals, positions, selection, pins and read-back."""

    @abstractmethod
    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None: ...

    @abstractmethod
    def remove(self, node_ids: DataFrame | None, edge_ids: DataFrame | None) -> None: ...

    @abstractmethod
    def set_positions(self, positions: DataFrame) -> None: ...

    @abstractmethod
    def nodes(self) -> DataFrame: ...

    @abstractmethod
    def edges(self) -> DataFrame: ...


def check_telemetry(options: dict) -> None:
    """Raises unless telemetry is switched off by exactly True."""
    if options.get("disable_telemetry") is not True:
        raise SinkError("telemetry must be disabled")


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with new's rows upserted: a field that new leaves null keeps its old value."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    a, b = old.select(key, *(F.col(c).alias(f"a_{c}") for c in old.columns if c != key)), new.select(key, *(F.col(c).alias(f"b_{c}") for c in new.columns if c != key))
    pick = lambda c: F.coalesce(*([F.col(f"b_{c}")] if c in new.columns else []), *([F.col(f"a_{c}")] if c in old.columns else []))
    return a.join(b, key, "full_outer").select(key, *(pick(c).alias(c) for c in fields))


class TableSink(GraphSink):
    """A sink that keeps its state as tables in the shared folder, and a log of what it was told."""

    def __init__(self, spark: SparkSession, options: dict):
        check_telemetry(options)
        self._spark = spark
        self._nodes = spark.createDataFrame([], "id string, x double, y double")
        self._edges = spark.createDataFrame([], "id string, source string, target string")
        self._selected = spark.createDataFrame([], "id string")
        self._pins: set[str] = set()
        self.log: list[str] = []

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.log.append("upsert")
        self._nodes = cut(merged(self._nodes, nodes.withColumn("id", F.col("id").cast("string"))), "sink-nodes")
        self._edges = cut(merged(self._edges, edges.withColumn("id", F.col("id").cast("string"))), "sink-edges")

    def remove(self, node_ids: DataFrame | None = None, edge_ids: DataFrame | None = None) -> None:
        """Removed nodes are deselected too."""
        if edge_ids is not None:
            self.log.append("remove-edges")
            self._edges = cut(self._edges.join(edge_ids, "id", "left_anti"), "sink-edges")
        if node_ids is not None:
            self.log.append("remove-nodes")
            self._nodes = cut(self._nodes.join(node_ids, "id", "left_anti"), "sink-nodes")
            self._selected = cut(self._selected.join(node_ids, "id", "left_anti"), "sink-selection")

    def set_positions(self, positions: DataFrame) -> None:
        """Moves nodes; positions of unknown ids are left out."""
        self.log.append("positions")
        known = positions.join(self._nodes.select("id"), "id", "left_semi").select("id", "x", "y")
        self._nodes = cut(merged(self._nodes, known), "sink-nodes")

    def select(self, ids: DataFrame) -> None:
        self.log.append("select")
        self._selected = cut(self._nodes.select("id").join(ids, "id", "left_semi"), "sink-selection")

    def pin(self, node: str) -> None:
        self.log.append("pin")
        self._pins.add(node)

    def unpin(self, node: str) -> None:
        self.log.append("unpin")
        self._pins.discard(node)

    def count(self, op: str) -> int:
        return self.log.count(op)

    def nodes(self) -> DataFrame:
        return self._nodes

    def edges(self) -> DataFrame:
        return self._edges

    def selected(self) -> DataFrame:
        return self._selected

    def node(self, node_id: str) -> DataFrame:
        return self._nodes.where(F.col("id") == node_id)

    def positions(self) -> DataFrame:
        return self._nodes.where(finite(F.col("x")) & finite(F.col("y"))).select("id", "x", "y")

    def take_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: rows (kind "node" or "edge", removed, id, ...) of one micro-batch."""
        gone, kept = batch.where("removed"), batch.where("not removed")
        self.remove(gone.where("kind = 'node'").select("id"), gone.where("kind = 'edge'").select("id"))
        self.upsert(kept.where("kind = 'node'").select("id", "x", "y"), kept.where("kind = 'edge'").select("id", "source", "target"))


def table_sinks(spark: SparkSession):
    """A factory of table sinks, for code that builds its sink once from options."""
    return lambda options: TableSink(spark, options)


def read_trace(text: str | None) -> list:
    """A stored JSON ring of trace lines, empty if there is none or it can't be read."""
    import json

    try:
        found = json.loads(text or "[]")
    except ValueError:
        return []
    return found if isinstance(found, list) else []
