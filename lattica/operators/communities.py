"""Coreness, core and periphery, and communities."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import vocab
from lattica.functions.scalars import community_slot, finite
from lattica.operators.aggregates import undirected
from lattica.sources.graphs import Graph
from lattica.sources.shared import cut

#: Kinds with fewer nodes are one community; share of nodes that must carry a community for it to be used.
LEAST_FOR_LOUVAIN, COVERAGE = 12, 0.6
#: Undirected edges of a kind up to which its communities are found in one task; beyond, by joins, to the same result.
MOST_PAIRS = 1_000_000
#: Rounds taken back in a row, each with half as many moves, before one node moves alone; one in how much is too little a rise.
STEPS, LEAST_RISE = 3, 10_000_000


def coreness(graph: Graph) -> DataFrame:
    """(id, core): the largest k such that the node is in a subgraph where all have k or more distinct neighbours. Nodes
    of at most k remaining neighbours are peeled until none are left, for one k after the other; the order doesn't
    matter, and empty levels are skipped."""
    pairs = undirected(graph.edges)
    ids = graph.nodes.select("id").distinct()
    pairs = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "pairs")
    left = cut(ids, "left")
    done, k = None, 0
    while True:
        degree = left.join(both.groupBy(F.col("a").alias("id")).count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("d"))
        degree = cut(degree, "degree")
        least = degree.agg(F.min("d").alias("least")).first()["least"]
        if least is None:
            break
        k = max(k, least)
        gone = cut(degree.where(F.col("d") <= k).select("id", F.lit(k).alias("core")), "core")
        done = gone if done is None else done.unionByName(gone)
        left = cut(left.join(gone, "id", "left_anti"), "left")
        both = cut(both.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"), "pairs")
    return done if done is not None else ids.select("id", F.lit(0).alias("core"))


def core_periphery(cores: DataFrame, theme: str = "dark") -> DataFrame:
    """(id, core, color): the core's colour from 0.6 of the highest shell on, but from 2 at least."""
    most = cores.agg(F.coalesce(F.max("core"), F.lit(0)).alias("most"))
    limit = F.greatest(F.lit(2), F.ceil(F.col("most").cast("double") * F.lit(0.6).cast("double")))
    color = F.when(F.col("core") >= limit, vocab.CORE[theme]).otherwise(vocab.PERIPHERY[theme])
    return cores.crossJoin(F.broadcast(most)).select("id", "core", color.alias("color"))  # one row


def louvain(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Communities of a simple undirected graph by Louvain's levels with moves in rounds, numbered from 0 by least node.

    In a round each node looks for the community, its own or a neighbour's, that raises modularity most, the least name
    among equals, its own first. Half of those that would move do, by hash; if that does not raise modularity, the round
    is taken back and a quarter tries, and so on, and after STEPS such rounds the one node that gains most. A level ends
    when no node gains, or when a round raises modularity by less than one in LEAST_RISE; its communities are the nodes
    of the next. All arithmetic is in whole numbers. moved_communities follows the same rules in DataFrames."""
    near: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for a, b in pairs:
        near[a][b] += 1
        near[b][a] += 1
    m2, member, r = 2 * len(pairs), {x: x for x in near}, 0

    def quality(of: dict[str, str], volume: dict[str, int]) -> int:
        return m2 * sum(w for a, row in near.items() for b, w in row.items() if of[a] == of[b]) - sum(v * v for v in volume.values())

    def volumes(of: dict[str, str]) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for a, c in of.items():
            out[c] += degree[a]
        return out

    while True:
        degree, of, step, changed = {a: sum(row.values()) for a, row in near.items()}, {a: a for a in near}, 0, False
        volume = volumes(of)
        before = quality(of, volume)
        while True:
            movers = {}
            for a, row in near.items():
                links: dict[str, int] = defaultdict(int, {of[a]: 0})
                for b, w in row.items():
                    if b != a:
                        links[of[b]] += w
                score = {c: w * m2 - (volume[c] - (degree[a] if c == of[a] else 0)) * degree[a] for c, w in links.items()}
                best = min(score, key=lambda c: (-score[c], c != of[a], c))
                if best != of[a]:
                    movers[a] = (score[of[a]] - score[best], a, best)
            if not movers:
                break
            go = movers if step <= STEPS else {min(movers.values())[1]}
            trial = of | {a: movers[a][2] for a in go if step > STEPS or zlib.crc32(f"{a}:{r}".encode()) % 2 ** (step + 1) == 0}
            r, volume = r + 1, volumes(trial)
            after = quality(trial, volume)
            if after <= before:
                step, volume = step + 1, volumes(of)
                continue
            rise, of, before, step, changed = after - before, trial, after, 0, True
            if rise * LEAST_RISE < m2 * m2:
                break
        if not changed:
            break
        name: dict[str, str] = {}
        for a in sorted(of):
            name.setdefault(of[a], a)
        member = {x: name[of[a]] for x, a in member.items()}
        grown: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for a, row in near.items():
            for b, w in row.items():
                grown[name[of[a]]][name[of[b]]] += w
        near = grown
    order = {c: k for k, c in enumerate(sorted(set(member.values())))}
    return {x: order[member[x]] for x in sorted(member)}


def partition(graph: Graph) -> DataFrame:
    """(id, community): the property `community` truncated, where 0.6 of the nodes have a finite one; else Louvain over
    the graph as one group, and nothing without edges. The second is for working sets within a venue's envelope."""
    if "community" in graph.nodes.columns and dict(graph.nodes.dtypes)["community"] in ("double", "float", "int", "bigint"):
        value = F.col("community").cast("double")
        share = graph.nodes.agg(F.avg(F.when(finite(value), 1.0).otherwise(0.0)).alias("share")).first()["share"]
        if (share or 0) >= COVERAGE:
            return graph.nodes.where(finite(value)).select("id", F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long").alias("community"))
    return _by_louvain(undirected(graph.edges).withColumn("kind", F.lit("all"))).select("id", "community")


def _by_louvain(pairs: DataFrame) -> DataFrame:
    """(kind, id, community) of pairs(kind, a, b): kinds of at most MOST_PAIRS are each worked on in one task, larger ones
    by joins, to the same result."""
    pairs = cut(pairs.select("kind", "a", "b"), "kinds")
    large = pairs.groupBy("kind").count().where(F.col("count") > MOST_PAIRS).select("kind")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = louvain(sorted(zip(frame["a"], frame["b"], strict=True)))
        return pd.DataFrame({"kind": frame["kind"].iloc[0], "id": list(found), "community": list(found.values())})

    small = pairs.join(large, "kind", "left_anti").groupBy("kind").applyInPandas(run, "kind string, id string, community long")
    if large.isEmpty():
        return small
    return small.unionByName(moved_communities(pairs.join(large, "kind", "left_semi")))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def _quality(near: DataFrame, label: DataFrame, m2: DataFrame) -> DataFrame:
    """(kind, m2, quality): modularity of label(kind, a, d, c), times the square of m2."""
    side = lambda x: label.select("kind", F.col("a").alias(x), F.col("c").alias(f"c_{x}"))
    inner = near.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"]).where("c_a = c_b").groupBy("kind").agg(F.sum("w").alias("inner"))
    volume = label.groupBy("kind", "c").agg(F.sum("d").alias("v")).groupBy("kind").agg(F.sum(_exact("v") * _exact("v")).alias("squares"))
    value = _exact("m2") * F.coalesce(_exact("inner"), F.lit(0).cast("decimal(18,0)")) - F.col("squares")
    return m2.join(volume, "kind").join(inner, "kind", "left").select("kind", "m2", value.cast("decimal(38,0)").alias("quality"))


def _movers(near: DataFrame, label: DataFrame, state: DataFrame) -> DataFrame:
    """(kind, a, loss, best): nodes that gain by going to the community best, loss being the gain's negative."""
    live = label.join(state.where("not done").select("kind", "m2"), "kind")
    links = near.where("a != b").join(label.select("kind", F.col("a").alias("b"), "c"), ["kind", "b"]).select("kind", "a", "c", "w")
    links = links.unionByName(label.select("kind", "a", "c", F.lit(0).cast("long").alias("w"))).groupBy("kind", "a", "c").agg(F.sum("w").alias("w"))
    volume = label.groupBy("kind", "c").agg(F.sum("d").alias("volume"))
    scored = links.join(volume, ["kind", "c"]).join(live.withColumnRenamed("c", "own"), ["kind", "a"])
    away = F.col("c") != F.col("own")
    loss = (F.when(away, _exact("volume")).otherwise(_exact("volume") - _exact("d")) * _exact("d") - _exact("w") * _exact("m2")).cast("decimal(38,0)")
    least = F.min(F.struct(loss.alias("loss"), away.alias("away"), F.col("c").alias("c")))
    found = scored.groupBy("kind", "a").agg(least.alias("best"), F.min(F.when(~away, loss)).alias("stay"))
    return found.where("best.away").select("kind", "a", (F.col("best.loss") - F.col("stay")).alias("loss"), F.col("best.c").alias("best"))


def moved_communities(pairs: DataFrame) -> DataFrame:
    """(kind, id, community) of pairs(kind, a, b), as louvain has them for each kind, by joins. Links to a community and
    volumes are pre-aggregated, so that hubs are never gathered; each round is written to the shared folder."""
    ends = lambda a, b: pairs.select("kind", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1).cast("long").alias("w"))
    near = cut(ends("a", "b").unionByName(ends("b", "a")), "near")
    m2 = cut(near.groupBy("kind").agg(F.sum("w").alias("m2")), "m2")
    member = cut(near.select("kind", F.col("a").alias("id"), F.col("a").alias("node")).distinct(), "member")
    rounds = m2.select("kind", F.lit(0).alias("r"))
    while True:
        label = cut(near.groupBy("kind", "a").agg(F.sum("w").alias("d")).withColumn("c", F.col("a")), "label")
        start = _quality(near, label, m2).join(rounds, "kind")
        state = cut(start.select("*", F.lit(0).alias("step"), F.lit(False).alias("changed"), F.lit(False).alias("done")), "state")
        while not state.where("not done").isEmpty():
            movers = cut(_movers(near, label, state), "movers")
            one = movers.groupBy("kind").agg(F.min(F.struct("loss", "a"))["a"].alias("one"))
            picked = movers.join(state.select("kind", "r", "step"), "kind").join(one, "kind")
            turn = F.crc32(F.concat("a", F.lit(":"), F.col("r").cast("string")).cast("binary")) % F.pow(F.lit(2), F.col("step") + 1).cast("long") == 0
            picked = picked.where(F.when(F.col("step") > STEPS, F.col("a") == F.col("one")).otherwise(turn)).select("kind", "a", "best")
            trial = cut(label.join(picked, ["kind", "a"], "left").select("kind", "a", "d", "c", F.coalesce("best", "c").alias("to")), "trial")
            after = _quality(near, trial.select("kind", "a", "d", F.col("to").alias("c")), m2).select("kind", F.col("quality").alias("after"))
            rose, found = F.col("after") > F.col("quality"), F.col("one").isNotNull()
            little = (F.col("after") - F.col("quality")).cast("decimal(30,0)") * LEAST_RISE < _exact("m2") * _exact("m2")
            state = state.join(after, "kind").join(one, "kind", "left")
            state = state.select("kind", "m2", F.greatest("after", "quality").alias("quality"), F.when(found, F.col("r") + 1).otherwise(F.col("r")).alias("r"), F.when(rose, 0).otherwise(F.col("step") + 1).alias("step"), (F.col("changed") | rose).alias("changed"), (F.col("done") | ~found | (rose & little)).alias("done"), rose.alias("rose"))
            state = cut(state, "state")
            label = trial.join(state.select("kind", "rose"), "kind").select("kind", "a", "d", F.when(F.col("rose"), F.col("to")).otherwise(F.col("c")).alias("c"))
            state = state.drop("rose")
        if state.where("changed").isEmpty():
            break
        name = label.groupBy("kind", "c").agg(F.min("a").alias("name"))
        to = cut(label.join(name, ["kind", "c"]).select("kind", "a", "name"), "names")
        side = lambda x, y: to.select("kind", F.col("a").alias(x), F.col("name").alias(y))
        member = cut(member.join(side("node", "up"), ["kind", "node"]).select("kind", "id", F.col("up").alias("node")), "member")
        near = near.join(side("a", "x"), ["kind", "a"]).join(side("b", "y"), ["kind", "b"])
        near = cut(near.groupBy("kind", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "near")
        rounds = state.select("kind", "r")
    return _numbered(member)


def _numbered(member: DataFrame) -> DataFrame:
    """(kind, id, community) of member(kind, id, node): each kind's nodes get numbers from 0 in their order, which is
    counted within ranges first, and then by the number of nodes in the ranges before."""
    names = member.select("kind", "node").distinct().repartitionByRange("kind", "node")
    names = cut(names.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = names.groupBy("kind", "part").count()
    ahead = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("kind", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("kind", "part").orderBy("node"))
    numbers = names.withColumn("k", inside).join(sizes, ["kind", "part"])
    numbers = numbers.select("kind", "node", (F.col("ahead") + F.col("k") - 1).cast("long").alias("community"))
    return member.join(numbers, ["kind", "node"]).select("kind", "id", "community")


def partition_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("community").alias("communities"), F.count("*").alias("covered"))


def community_colors(found: DataFrame) -> DataFrame:
    return found.select("id", community_slot(F.col("community")).alias("color"))


def lens_colors(lens: str, graph: Graph, theme: str = "dark") -> DataFrame:
    """(id, color) by lens: communities, core-periphery, or none for raw."""
    if lens == "communities":
        return community_colors(partition(graph))
    if lens == "core-periphery":
        return core_periphery(coreness(graph), theme).select("id", "color")
    return graph.nodes.select("id", F.lit(None).cast("string").alias("color")).limit(0)


def kind_communities(graph: Graph) -> DataFrame:
    """(id, community_id, kind): for each kind with 12 nodes or more, Louvain over the edges inside the kind; nodes it
    doesn't reach, and kinds without inner edges, are community 0; smaller kinds are one community."""
    size = F.count("*").over(Window.partitionBy("kind"))
    nodes = graph.nodes.select("id", "kind").withColumn("size", size)
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("size").alias(f"{c}_size"))
    inner = graph.edges.select("source", "target").join(end("source"), "source").join(end("target"), "target").where((F.col("source_kind") == F.col("target_kind")) & (F.col("source_size") >= LEAST_FOR_LOUVAIN))
    pairs = inner.where("source != target").select(F.col("source_kind").alias("kind"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    found = _by_louvain(pairs).select("id", "community")
    name = F.concat(F.lit("community-"), F.lower("kind"))
    full = F.when(F.col("size") < LEAST_FOR_LOUVAIN, name).otherwise(F.concat(name, F.lit("-"), F.coalesce("community", F.lit(0)).cast("string")))
    return nodes.join(found, "id", "left").select("id", full.alias("community_id"), "kind")


def community_table(found: DataFrame) -> DataFrame:
    """(community_id, kind, size, tone, color, strong_color) of kind_communities' result."""
    return found.groupBy("community_id", "kind").agg(F.count("*").alias("size")).select("community_id", "kind", "size", F.lit(vocab.SLICE_TONE).alias("tone"), F.lit(vocab.SLICE_COLOR).alias("color"), F.lit(vocab.SLICE_STRONG).alias("strong_color"))
