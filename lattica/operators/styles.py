"""Declarative styling: rules to sparse patches, patches to deltas, and backend rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalars, vocab
from lattica.functions.identity import community_color

PATCH = ["color", "size", "brightness", "dashed", "provenance_badge"]


def source_value(source: str) -> Column:
    """The measure that a rule's source names; nothing for property sources, which contract nodes don't carry."""
    return F.lit(None).cast("double") if source.startswith("prop:") else F.col("measures")[source]


def style_patches(nodes: DataFrame, rules: tuple[vocab.Rule, ...]) -> DataFrame:
    """(ref, color, size, brightness, dashed, provenance_badge): rules in order, a later one over an earlier one. A
    colour is that of the node's community; of its own first role, for the source prop:roles; else of the rule's role."""
    color, size, bright = (F.lit(None).cast(t) for t in ("string", "double", "double"))
    for rule in rules:
        value = source_value(rule.source)
        if rule.channel == "color":
            if rule.source == "community":
                new = F.when(F.coalesce(F.col("community"), F.lit("")) != "", community_color(F.col("community")))
            else:
                role = F.try_element_at(F.col("roles"), F.lit(1)) if rule.source == "prop:roles" else F.lit(rule.role).cast("string")
                new = F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("var(--fx-role-"), role, F.lit(")")))
            color = F.coalesce(new, color)
        elif rule.channel == "size":
            size = F.coalesce(F.when(value.isNotNull(), scalars.size_of(value)), size)
        elif rule.channel == "brightness":
            bright = F.coalesce(value, bright)
    return nodes.select(F.col("id").alias("ref"), color.alias("color"), size.alias("size"), bright.alias("brightness"), scalars.is_dashed(F.col("provenance")).alias("dashed"), F.col("provenance").alias("provenance_badge"))


def style_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(ref, change): refs whose patch is new, changed or removed. Fields are compared null-safely."""
    pack = lambda df, name: df.select("ref", F.struct(*PATCH).alias(name))
    both = pack(before, "a").join(pack(now, "b"), "ref", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("ref", change.alias("change")).where("change is not null")


def effective_style(before: DataFrame, now: DataFrame) -> DataFrame:
    """What a sink that merges fields shows: a field that a new patch leaves out keeps its old value."""
    a, b = before.select("ref", *(F.col(c).alias(f"a_{c}") for c in PATCH)), now.select("ref", *(F.col(c).alias(f"b_{c}") for c in PATCH))
    return a.join(b, "ref", "full_outer").select("ref", *(F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in PATCH))


def edge_widths(edges: DataFrame) -> DataFrame:
    """edges with width, by the heaviest edge."""
    most = edges.agg(F.coalesce(F.greatest(F.max("weight"), F.lit(0.0)), F.lit(0.0)).alias("most"))
    return edges.crossJoin(F.broadcast(most)).withColumn("width", scalars.edge_width(F.col("weight"), F.col("most"))).drop("most")  # one row


def backend_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "label", "x", "y")


def encoded(results: DataFrame, kind: str, channel: str | None = None) -> DataFrame:
    """A result table as visual columns: scores become size or brightness besides their raw value, communities become
    a category; other kinds stay as they are."""
    if kind == "scores":
        return results.select("node_id", F.when(F.lit(channel == "size"), F.col("value")).alias("size"), F.when(F.lit(channel != "size"), F.col("value")).alias("brightness"), F.col("value").alias("raw_value"))
    if kind == "communities":
        return results.select("node_id", F.col("community").alias("community_id"))
    return results
