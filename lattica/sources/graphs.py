"""Graphs from tables: nodes(id, ord, ...) and edges(source, target, ord, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Graph:
    """A working set: nodes with unique ids, directed edges in an explicit order."""

    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, revenue, n): revenue from customers of one nation to suppliers of another, by nation key."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("target"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey).join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
    return joined.groupBy("source", "target").agg(F.sum("value").alias("revenue"), F.count("*").alias("n"))


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations as nodes, trade as edges weighted by revenue in millions, rounded to four digits."""
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("region"))
    edges = trade_edges(spark, sf_dir).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.round(F.col("revenue") / 1e6, 4).alias("weight"), (F.col("source") * 100 + F.col("target")).cast("long").alias("ord"))
    return Graph(nodes, edges)


def sparse_graph(spark: SparkSession, sf_dir: str, keep: int = 3) -> Graph:
    """The nation graph with each nation's `keep` largest partners; the cost of an edge is 100 by its weight, in whole
    thousandths, so that sums are exact."""
    full = nation_graph(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
    edges = full.edges.where("source != target and weight > 0").withColumn("rank", rank).where(F.col("rank") <= keep)
    cost = F.floor(100000 / F.col("weight")).cast("double") / 1000
    return Graph(full.nodes, edges.select("source", "target", cost.alias("weight"), "ord"))


def sanitized(graph: Graph) -> Graph:
    """Without nodes of empty ids, later nodes of a repeated id, and edges with an unknown end; repeated edges stay."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    nodes = graph.nodes.where("id is not null and id != ''").withColumn("_n", first).where("_n = 1").drop("_n")
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes, edges)
