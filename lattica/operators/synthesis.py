"""Edges that entities declare in their properties, and the slice pipeline around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.identity import match_key
from lattica.operators.aggregates import counts_by_kind
from lattica.operators.communities import community_table, kind_communities
from lattica.sources.graphs import Graph, sanitized

# Two-letter country codes and the names that countries carry.
COUNTRY_CODES = {
    "us": "united states of america", "gb": "united kingdom of great britain and northern ireland", "uk": "united kingdom of great britain and northern ireland", "de": "germany", "jp": "japan", "cn": "china", "br": "brazil", "in": "india", "tr": "türkiye", "ng": "nigeria", "mx": "mexico",
    "sg": "singapore", "hk": "hong kong", "ch": "switzerland", "ca": "canada", "au": "australia", "fr": "france", "es": "spain", "it": "italy", "pl": "poland", "kr": "korea", "id": "indonesia",
}
# Issuers and the coins they issue.
ISSUERS = {
    "circle": ["USDC", "EURC"], "tether": ["USDT", "EURT"], "paxos": ["USDP", "PYUSD", "BUSD"], "mountain protocol": ["USDM"], "agora": ["AUSD"], "bilira": ["TRYB"], "etherfuse": ["MXNB", "BRZA"], "transfero": ["BRZ"], "transferro": ["BRZ"], "brale": ["BRZ"], "frax": ["FRAX"],
    "makerdao": ["DAI"], "maker": ["DAI"], "sky protocol": ["USDS"], "sky": ["USDS"], "ondo": ["USDY"], "first digital": ["FDUSD"], "trueusd": ["TUSD"], "trust token": ["TUSD"], "gemini": ["GUSD"], "binance": ["BUSD"], "hashnote": ["USDB"],
}
COUNTRY_PROPS = ["country", "jurisdiction", "homeCountry", "headquarters", "iso3", "iso2"]
CURRENCY_PROPS = ["digitalCurrency", "currency", "valuationCurrency", "denominatedIn"]


def _keys(nodes: DataFrame, props: list[str]) -> DataFrame:
    """(key, id, ord): each non-empty match key of each node's id, label and properties."""
    found = F.array(match_key("id"), match_key("label"), *(match_key(F.col("props")[p]) for p in props))
    return nodes.select("id", "ord", F.explode(F.array_distinct(found)).alias("key")).where("key != ''")


def country_index(nodes: DataFrame) -> DataFrame:
    """(key, target): countries by id, label, name and codes, and by the fixed two-letter codes of what their name, or
    else their label, says; the last node that has a key wins, however it has it."""
    countries = nodes.where("kind = 'Country'")
    codes = nodes.sparkSession.createDataFrame(list(COUNTRY_CODES.items()), "key string, named string")
    named = countries.select("id", "ord", match_key(F.coalesce(F.col("props")["name"], F.col("label"))).alias("named"))
    more = named.join(F.broadcast(codes), "named").select("id", "ord", "key")  # a fixed table
    return _keys(countries, ["name", "iso3", "iso2"]).unionByName(more, allowMissingColumns=True).groupBy("key").agg(F.max_by("id", "ord").alias("target"))


def currency_index(nodes: DataFrame) -> DataFrame:
    """(key, target): currencies by id, label, code, symbol and name, the last winning; assets, the first winning, only
    under keys that no currency has."""
    own = _keys(nodes.where("kind = 'Currency'"), ["code", "symbol", "name"]).groupBy("key").agg(F.max_by("id", "ord").alias("target"))
    assets = _keys(nodes.where("kind = 'Asset'"), ["symbol", "name"]).groupBy("key").agg(F.min_by("id", "ord").alias("target"))
    return own.unionByName(assets.join(own.select("key"), "key", "left_anti"))


def _anchored(sources: DataFrame, props: list[str], index: DataFrame, kind) -> DataFrame:
    """(source, target, kind): each source's first property that the index knows."""
    wanted = sources.select("id", "kind", F.posexplode(F.array(*(match_key(F.col("props")[p]) for p in props))).alias("rank", "key")).where("key != ''")
    return wanted.join(index, "key").groupBy("id", "kind").agg(F.min_by("target", "rank").alias("target")).select(F.col("id").alias("source"), "target", kind.alias("kind"))


def property_edges(graph: Graph) -> DataFrame:
    """(id, source, target, kind) of edges that nodes(id, kind, label, props, ord) declare in their properties and that
    edges(source, target, kind) doesn't have yet."""
    nodes = graph.nodes
    sources = nodes.where("kind not in ('Country', 'Currency') and props is not null")
    countries, currencies = country_index(nodes), currency_index(nodes)
    place = F.when(F.col("kind") == "FinancialInstitution", "HEADQUARTERED_IN").otherwise("IN_COUNTRY")
    found = _anchored(sources, COUNTRY_PROPS, countries, place).unionByName(_anchored(sources, CURRENCY_PROPS, currencies, F.lit("USES_CURRENCY")))
    coins = nodes.sparkSession.createDataFrame([(k, c.lower()) for k, cs in ISSUERS.items() for c in cs], "issuer string, key string")
    partner = sources.where("kind = 'Partner'").select("id", match_key(F.coalesce("label", F.col("props")["name"], "id")).alias("issuer"))
    issued = partner.join(F.broadcast(coins), "issuer").join(currencies, "key").select(F.col("id").alias("source"), "target", F.lit("ISSUES_CURRENCY").alias("kind"))
    fresh = found.unionByName(issued).where("source != target").distinct().join(graph.edges.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")
    return fresh.select(F.concat_ws(":", F.lit("synth"), "source", "target", "kind").alias("id"), "source", "target", "kind")


def built_slice(graph: Graph, upstream: list[str], layout: bool = True) -> dict[str, DataFrame]:
    """nodes, edges, communities and counts of a cleaned, completed slice; with layout, nodes have x, y, z and close2d."""
    from lattica.operators.layout import close_layout, force_layout

    clean = sanitized(graph)
    edges = clean.edges.select("id", "source", "target", "kind").unionByName(property_edges(clean))
    whole = Graph(clean.nodes, edges)
    member = kind_communities(whole)
    nodes = clean.nodes.join(member.select("id", "community_id"), "id")
    if layout:
        placed = force_layout(nodes, edges)
        close = close_layout(placed, edges).select("id", F.struct(F.col("x").alias("x"), F.col("y").alias("y")).alias("close2d"))
        nodes = nodes.join(placed.select("id", "x", "y", "z"), "id").join(close, "id", "left")
    first = Window.partitionBy("community_id")
    ordered = nodes.withColumn("community_ord", F.min("ord").over(first))
    return {"nodes": ordered, "edges": edges, "communities": community_table(member), "counts": counts_by_kind(clean.nodes, edges, upstream)}
