"""Integrity rules over payload tables: one row for each breach, or an error for the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import vocab
from lattica.functions.identity import is_ref
from lattica.functions.scalars import finite

DID = r"(?i)\bdid:[a-z0-9]+:"
EMAIL = r"(?i)[^\s@]+@[^\s@]+\.[a-z]{2,}"


class PayloadError(ValueError):
    """A payload that breaks a rule; rule names it."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


def sensitive(text: Column) -> Column:
    """"did" or "email" for text with such an identifier, else null."""
    return F.when(F.regexp_like(text, F.lit(DID)), "did").when(F.regexp_like(text, F.lit(EMAIL)), "email")


def _outside(x: Column, allowed: list[str]) -> Column:
    """Whether x is given and not one of the allowed."""
    return x.isNotNull() & ~x.isin(allowed)


def violations(nodes: DataFrame, edges: DataFrame, audience: str, positions: bool = False, token_layers: list[str] | None = None, legacy_ids: bool = False) -> DataFrame:
    """(phase, ord, rank, rule, entity) of every breach. Nodes come first, then edges, then the header; a null counts as
    absent. Uniqueness and ends are checked by windows and anti joins, so no side is gathered."""
    operator = audience == "operator"
    col = F.col
    again = F.row_number().over(Window.partitionBy("id").orderBy("ord")) > 1
    text = lambda c: sensitive(col(c)).isNotNull()
    unknown = F.exists(F.coalesce(F.map_keys("measures"), F.array().cast("array<string>")), lambda k: ~k.isin(vocab.MEASURES))
    rules: list[tuple[str, str, Column]] = [
        ("identity", "malformed-ref", ~is_ref("id")),
        ("identity", "duplicate-node", col("_again")),
        ("pii", "member", F.lit(not operator) & (col("kind") == "member")),
        ("pii", "label", text("label")),
        ("pii", "id", F.lit(not operator) & text("id")),
        ("provenance", "node-provenance", ~F.coalesce(col("provenance").isin(vocab.PROVENANCES), F.lit(False))),
        ("confidential", "measure", unknown),
        ("confidential", "token-layer", _outside(col("token_layer"), vocab.TOKEN_LAYERS)),
        ("confidential", "token-layer-not-allowed", _outside(col("token_layer"), token_layers) if token_layers is not None else F.lit(False)),
        ("contract", "position", F.lit(positions) & ~(finite(col("x")) & finite(col("y")))),
    ]
    marked = nodes.withColumn("_again", again)
    found = [marked.where(F.coalesce(bad, F.lit(False))).select(F.lit(0).alias("phase"), "ord", F.lit(i).alias("rank"), F.lit(f"{rule}:{what}").alias("rule"), col("id").alias("entity")) for i, (rule, what, bad) in enumerate(rules)]
    ids = nodes.select("id").distinct()
    dangling = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")).dropDuplicates(["id", "ord"])
    more: list[tuple[str, str, DataFrame]] = [
        ("identity", "duplicate-edge", edges.withColumn("_again", again).where("_again").drop("_again")),
        ("contract", "dangling", dangling),
        ("provenance", "edge-provenance", edges.where(~F.coalesce(col("provenance").isin(vocab.PROVENANCES), F.lit(False)))),
        ("confidential", "settlement", edges.where(_outside(col("settlement_state"), vocab.SETTLEMENT_STATES))),
    ]
    found += [rows.select(F.lit(1).alias("phase"), "ord", F.lit(i).alias("rank"), F.lit(f"{rule}:{what}").alias("rule"), col("id").alias("entity")) for i, (rule, what, rows) in enumerate(more)]
    if legacy_ids and audience == "public":
        found.append(nodes.sparkSession.createDataFrame([(2, 0, 0, "contract:legacy-ids", "header")], "phase int, ord long, rank int, rule string, entity string"))
    return reduce(DataFrame.unionByName, found)


def checked(nodes: DataFrame, edges: DataFrame, audience: str, **options) -> tuple[DataFrame, DataFrame]:
    """nodes and edges themselves; raises for the first breach in payload order."""
    first = violations(nodes, edges, audience, **options).orderBy("phase", "ord", "rank").limit(1).collect()
    if first:
        raise PayloadError(first[0]["rule"], first[0]["entity"])
    return nodes, edges


def header(spark, audience: str, tier: str, framing: str, key: str, total_nodes: int | None = None, total_edges: int | None = None, sampled: bool = False, positions: bool = False) -> DataFrame:
    """The payload's header row. A public payload's totals are left out."""
    shown = audience != "public"
    row = (key, 1, audience, tier, framing, total_nodes if shown else None, total_edges if shown else None, sampled, positions)
    return spark.createDataFrame([row], "cache_key string, version int, audience string, tier string, framing string, total_nodes long, total_edges long, sampled boolean, positions_included boolean")


def gate(nodes: DataFrame, tier: str, version: int = 1) -> int:
    """The number of nodes; raises for an unknown version or tier, and beyond the tier's budget. Never takes fewer."""
    if version != 1:
        raise PayloadError("version", str(version))
    if tier not in vocab.TIER_BUDGETS:
        raise PayloadError("tier", tier)
    n = nodes.count()
    if n > vocab.TIER_BUDGETS[tier][0]:
        raise PayloadError("budget", f"{n} nodes in tier {tier}")
    return n


def rescan(nodes: DataFrame) -> None:
    """Raises for a node with a sensitive label, or with a measure that isn't known, whatever the sender has checked."""
    text = sensitive(F.col("label")) if "label" in nodes.columns else F.lit(None)
    unknown = F.exists(F.map_keys("measures"), lambda k: ~k.isin(vocab.MEASURES)) if "measures" in nodes.columns else F.lit(False)
    rule = F.when(text.isNotNull(), "pii").when(F.coalesce(unknown, F.lit(False)), "confidential")
    first = nodes.select(F.col("ord" if "ord" in nodes.columns else "id").alias("at"), "id", rule.alias("rule")).where("rule is not null").orderBy("at").limit(1).collect()
    if first:
        raise PayloadError(first[0]["rule"], first[0]["id"])


def layout_for(positions: bool, nodes: int, allow_simulation: bool = True, most: int = 2000) -> str:
    """"free" for a payload with positions; else "d3Force" where that is allowed and small enough."""
    if positions:
        return "free"
    if allow_simulation and nodes <= most:
        return "d3Force"
    raise PayloadError("layout", f"{nodes} nodes without positions")


def is_trivial_partition(communities: int, covered: int) -> bool:
    return covered == 0 or communities <= 1 or communities >= covered
