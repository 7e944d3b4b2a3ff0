"""Label selection under a budget, and greedy placement without overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import scalars
from lattica.functions.scalars import finite


def label_score(rank_measure: str | None = None) -> Column:
    """The rank measure where a node has its key, null counting as 0; else degree, else magnitude, else 0."""
    m = F.col("measures")
    fall = F.coalesce(m["degree"], m["magnitude"], F.lit(0.0))
    if rank_measure is None:
        return fall
    return F.when(F.coalesce(F.map_contains_key(m, rank_measure), F.lit(False)), F.coalesce(m[rank_measure], F.lit(0.0))).otherwise(fall)


def picked_labels(nodes: DataFrame, budget: int, rank_measure: str | None = None) -> DataFrame:
    """(id, label, score, rank): at most `budget` nodes, named ones before generic ones, by score and then id. Of each
    generic text two at most. Only the top of the order is sorted as a whole."""
    if budget <= 0:
        return nodes.limit(0).select("id", "label", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    generic = F.coalesce(F.col("label_quality") == "generic", F.lit(False))
    scored = nodes.select("id", "label", label_score(rank_measure).alias("score"), generic.alias("generic"))
    named = scored.where("not generic")
    alike = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))
    few = scored.where("generic").withColumn("alike", alike).where("alike <= 2").drop("alike")
    top = named.unionByName(few).orderBy("generic", F.desc("score"), "id").limit(budget)
    rank = F.row_number().over(Window.orderBy("generic", F.desc("score"), "id")) - 1  # over the budget's rows
    return top.select("id", "label", "score", rank.alias("rank"))


def candidates(labels: DataFrame, scale: float, pan: tuple[float, float], size: tuple[float, float], top_inset: float = 0.0) -> DataFrame:
    """(id, rank, x, y, font_px, opacity, rect) of labels(id, label, rank, x, y, anchor_radius) near the pane."""
    width, height = size
    s = F.lit(scale)
    sx, sy = (scalars.world_to_screen(F.col(c), F.lit(p), F.lit(e), s) for c, p, e in (("x", pan[0], width), ("y", pan[1], height)))
    near = labels.where(finite(F.col("x")) & finite(F.col("y"))).withColumns({"sx": sx, "sy": sy, "tier": scalars.label_tier(F.col("rank"))})
    near = near.where(F.col("sx").between(-80, width + 80) & F.col("sy").between(-40, height + 40))
    x = scalars.clamp_label_x(F.col("sx"), F.col("label"), F.col("tier.font_px"), F.lit(width))
    y = F.col("sy") + F.coalesce(F.col("anchor_radius"), F.lit(12.5)) * s + 5
    out = near.select("id", "label", "rank", x.alias("x"), y.alias("y"), "tier.font_px", "tier.opacity").where(F.col("y") >= top_inset)
    return out.withColumn("rect", scalars.label_rect(F.col("x"), F.col("y"), F.col("label"), F.col("font_px")))


def placed_labels(found: DataFrame) -> DataFrame:
    """Candidates that no better ranked placed one overlaps. A fold over one array: a label budget is at most 200."""
    kind = "array<struct<rank:int,id:string,x:double,y:double,rect:struct<left:double,top:double,right:double,bottom:double>>>"
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), "x", "y", "rect")
    free = lambda kept, c: ~F.exists(kept, lambda k: scalars.overlaps(c["rect"], k["rect"]))
    add = lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept)
    every = found.agg(F.sort_array(F.collect_list(item)).cast(kind).alias("all"))
    return every.select(F.explode(F.aggregate("all", F.array().cast(kind), add)).alias("p")).select("p.id", "p.rank", "p.x", "p.y")


def label_layer(nodes: DataFrame, positions: DataFrame, budget: int, rank_measure: str | None = None, by_size: str | None = None) -> DataFrame:
    """Picked labels with positions, live ones before their own, and with half the node's size as the anchor's radius."""
    top = picked_labels(nodes, budget, rank_measure)
    size = scalars.size_of(F.col("measures")[by_size]) if by_size else F.lit(None).cast("double")
    live = positions.select("id", F.col("x").alias("live_x"), F.col("y").alias("live_y"))
    own = nodes.select("id", F.col("x").alias("own_x"), F.col("y").alias("own_y"), size.alias("size"))
    both = top.join(own, "id").join(live, "id", "left")
    return both.select("id", "label", "rank", F.coalesce("live_x", "own_x").alias("x"), F.coalesce("live_y", "own_y").alias("y"), scalars.anchor_radius(F.col("size")).alias("anchor_radius"))


def grouped_placement(found: DataFrame, by: str) -> DataFrame:
    """placed_labels for many panes at once, by the column `by`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in frame.sort_values("rank").itertuples():
            r = row.rect
            if all(not (r["left"] < k["right"] and k["left"] < r["right"] and r["top"] < k["bottom"] and k["top"] < r["bottom"]) for _, k in kept):
                kept.append((row.Index, r))
        return frame.loc[[i for i, _ in kept], [by, "id", "rank", "x", "y"]]

    return found.groupBy(by).applyInPandas(run, f"{by} {found.schema[by].dataType.simpleString()}, id string, rank int, x double, y double")
