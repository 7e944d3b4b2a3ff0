"""The engine's operators as queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import identity, scalars, vocab
from lattica.operators import aggregates, centrality, communities, incremental, labels, layout, paths, spatial, styles, synthesis, validate
from lattica.plans import registry
from lattica.plans.catalog import query
from lattica.sources.graphs import Graph, nation_graph, sanitized, sparse_graph, table
from lattica.streaming import machines

_TRADE = """trade AS (SELECT c.c_nationkey AS s, u.s_nationkey AS t, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier u ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS (SELECT s::VARCHAR AS source, t::VARCHAR AS target, round(revenue / 1e6, 4) AS weight, (s * 100 + t)::BIGINT AS ord FROM trade)"""
_DEGREES = """ends AS (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges),
degrees AS (SELECT n_nationkey::VARCHAR AS id, n_name AS label, n_regionkey::VARCHAR AS region, count(e.id)::BIGINT AS degree, count(DISTINCT CASE WHEN e.other != e.id THEN e.other END)::BIGINT AS neighbours
  FROM nation LEFT JOIN ends e ON e.id = n_nationkey::VARCHAR GROUP BY ALL)"""
_SPARSE = _TRADE + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM edges WHERE source != target AND weight > 0),
sparse AS (SELECT source, target, floor(100000 / weight)::DOUBLE / 1000 AS weight, ord FROM ranked WHERE r <= 3)"""


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query("trade_degree", f"WITH {_TRADE}, {_DEGREES} SELECT id, degree, neighbours FROM degrees")
def trade_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    return aggregates.degrees(g.nodes, g.edges)


def _styled_nodes(spark: SparkSession, sf_dir: str, before: int | None = None) -> DataFrame:
    """Nations with measures, roles, a community and a provenance; before keeps nations with smaller keys."""
    g = nation_graph(spark, sf_dir)
    nodes = g.nodes if before is None else g.nodes.where(F.col("ord") < before)
    found = aggregates.degrees(g.nodes, g.edges).select("id", F.col("degree").cast("double").alias("degree"))
    role = F.element_at(F.array(*map(F.lit, vocab.DATA_ROLES)), (F.col("ord") % 5 + 1).cast("int"))
    return nodes.join(found, "id").select("id", "ord", "label", F.lit(None).cast("string").alias("label_quality"), F.create_map(F.lit("degree"), F.col("degree")).alias("measures"), F.array(role).alias("roles"), F.when(F.col("ord") % 4 != 3, F.concat(F.lit("community:v7-"), "region")).alias("community"), F.when(F.col("ord") % 3 == 0, "illustrative").otherwise("real").alias("provenance"))


@query("label_topk", f"WITH {_TRADE}, {_DEGREES} SELECT id, label, degree::DOUBLE AS score, (row_number() OVER (ORDER BY degree DESC, id) - 1)::INTEGER AS rank FROM degrees ORDER BY degree DESC, id LIMIT 10")
def label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.picked_labels(_styled_nodes(spark, sf_dir), 10)


@query(
    "label_topk_named",
    """WITH n AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size > 10 THEN p_brand ELSE p_name END AS label, p_size > 10 AS generic, CASE WHEN p_size % 7 = 0 THEN 0.0 WHEN p_size % 5 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS score FROM part),
  k AS (SELECT *, row_number() OVER (PARTITION BY generic, label ORDER BY score DESC, id) AS alike FROM n)
  SELECT id, label, score, (row_number() OVER (ORDER BY generic, score DESC, id) - 1)::INTEGER AS rank FROM k WHERE NOT generic OR alike <= 2 ORDER BY generic, score DESC, id LIMIT 500""",
)
def label_topk_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    null = F.lit(None).cast("double")
    measures = F.when(F.col("p_size") % 7 == 0, F.create_map(F.lit("score"), null)).when(F.col("p_size") % 5 == 0, F.create_map(F.lit("degree"), F.col("p_size").cast("double"))).otherwise(F.create_map(F.lit("score"), F.col("p_retailprice"), F.lit("degree"), F.lit(1.0)))
    generic = F.col("p_size") > 10
    nodes = part.select(F.col("p_partkey").cast("string").alias("id"), F.when(generic, F.col("p_brand")).otherwise(F.col("p_name")).alias("label"), F.when(generic, "generic").alias("label_quality"), measures.alias("measures"))
    return labels.picked_labels(nodes, 500, "score")


@query("node_sizes", f"WITH {_TRADE}, {_DEGREES} SELECT id, least(48.0, greatest(6.0, floor(2 * sqrt(degree) + 0.5)))::DOUBLE AS size FROM degrees")
def node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    return aggregates.degrees(g.nodes, g.edges).select("id", scalars.size_of(F.col("degree").cast("double")).alias("size"))


@query("edge_widths", f"WITH {_TRADE} SELECT source, target, round(CASE WHEN (SELECT max(weight) FROM edges) > 0 THEN 0.6 + 1.8 * sqrt(greatest(0, weight) / (SELECT max(weight) FROM edges)) ELSE 1 END, 6) AS width FROM edges")
def edge_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.edge_widths(nation_graph(spark, sf_dir).edges).select("source", "target", *_six("width"))


@query("edge_costs", f"WITH {_TRADE} SELECT source, target, round(-ln(weight), 6) AS cost FROM edges WHERE weight > 0")
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nation_graph(spark, sf_dir).edges.where("weight > 0")
    return edges.select("source", "target", scalars.edge_cost(F.lit(None).cast("double"), F.col("weight")).alias("cost")).select("source", "target", *_six("cost"))


@query("minmax_scores", f"WITH {_TRADE}, {_DEGREES} SELECT id, degree::DOUBLE AS value, round(CASE WHEN (SELECT max(degree) - min(degree) FROM degrees) > 0 THEN (degree - (SELECT min(degree) FROM degrees)) / (SELECT (max(degree) - min(degree))::DOUBLE FROM degrees) ELSE CASE WHEN (SELECT max(degree) FROM degrees) > 0 THEN 1 ELSE 0 END END, 6) AS norm FROM degrees")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    found = aggregates.degrees(g.nodes, g.edges).select("id", F.col("degree").cast("double").alias("value"))
    return aggregates.normalized(found).select("id", "value", *_six("norm"))


_HASH = "list_reduce([2166136261::BIGINT] || list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_PALETTE = "[" + ", ".join(f"'{c}'" for c in vocab.REF_PALETTE) + "]"
_STYLED = f"""{_TRADE}, {_DEGREES}, styled AS (SELECT id, id::BIGINT AS ord, degree::DOUBLE AS degree, ['money','flow','governance','topology','compliance'][(id::BIGINT % 5 + 1)::INTEGER] AS role,
  CASE WHEN id::BIGINT % 4 != 3 THEN 'community:v7-' || region END AS community, CASE WHEN id::BIGINT % 3 = 0 THEN 'illustrative' ELSE 'real' END AS provenance FROM degrees),
patches AS (SELECT id AS ref, ord, CASE WHEN community IS NOT NULL THEN {_PALETTE}[({_HASH.format("community")} % 10 + 1)::INTEGER] ELSE 'var(--fx-role-topology)' END AS color,
  degree AS brightness, provenance = 'illustrative' AS dashed, provenance AS provenance_badge FROM styled)"""
_RULES = (*vocab.LENSES["communities"].rules, *vocab.LENSES["core-periphery"].rules)


@query("style_patches", f"WITH {_STYLED} SELECT ref, color, brightness, dashed, provenance_badge FROM patches")
def style_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.style_patches(_styled_nodes(spark, sf_dir), _RULES).drop("size")


@query(
    "style_diff",
    f"""WITH {_STYLED}, a AS (SELECT * FROM patches WHERE ord < 20), b AS (SELECT ref, color, dashed, provenance_badge FROM patches WHERE ord >= 5)
  SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'added' WHEN b.ref IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.ref = b.ref WHERE a.ref IS NULL OR b.ref IS NULL OR a.brightness IS NOT NULL""",
)
def style_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = styles.style_patches(_styled_nodes(spark, sf_dir, 20), _RULES)
    now = styles.style_patches(_styled_nodes(spark, sf_dir).where("ord >= 5"), vocab.LENSES["communities"].rules)
    return styles.style_delta(before, now)


@query(
    "effective_style",
    f"""WITH {_STYLED}, a AS (SELECT * FROM patches WHERE ord < 20), b AS (SELECT * FROM patches WHERE ord >= 5)
  SELECT coalesce(a.ref, b.ref) AS ref, coalesce(b.color, a.color) AS color, a.brightness AS brightness FROM a FULL JOIN b ON a.ref = b.ref""",
)
def effective_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = styles.style_patches(_styled_nodes(spark, sf_dir, 20), _RULES)
    now = styles.style_patches(_styled_nodes(spark, sf_dir).where("ord >= 5"), vocab.LENSES["communities"].rules)
    return styles.effective_style(before, now).select("ref", "color", "brightness")


def _orders(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != status).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")


@query("element_diff", "SELECT o_orderkey::VARCHAR AS id, 'remove' AS op FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey::VARCHAR, 'upsert' FROM orders WHERE o_orderstatus != 'F'")
def element_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return incremental.element_diff(every, _orders(spark, sf_dir, "F"))


@query("diff_applied", "SELECT o_orderkey::VARCHAR AS id, o_totalprice FROM orders WHERE o_orderstatus != 'F'")
def diff_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda df: df.select(F.col("id").cast("string").alias("id"), "o_totalprice")
    old, new = text(_orders(spark, sf_dir, "P")), text(_orders(spark, sf_dir, "F"))
    return incremental.applied(old, incremental.element_diff(old, new), new)


@query(
    "refs_minted",
    """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_nationkey % 6 = 4 THEN NULL WHEN n_nationkey % 6 = 3 THEN NULL ELSE 'country:' || trim(n_name) END AS ref,
  CASE n_nationkey % 6 WHEN 5 THEN 'unknown-kind' WHEN 4 THEN 'positional-member' WHEN 3 THEN 'colon-in-key' END AS error,
  'corridor:' || upper(n_name) || '→' || upper(n_name) || '·swift' AS corridor, 'community:v7-' || n_nationkey AS community, 'code:a/' || n_name AS code, 'country' AS parsed_kind, n_name || ':x' AS parsed_key FROM nation""",
)
def refs_minted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("n_nationkey"), F.col("n_name")
    kind = F.when(n % 6 == 5, "planet").otherwise("country")
    key = F.when(n % 6 == 4, F.concat(F.lit("Member-x-"), n.cast("string"))).when(n % 6 == 3, F.concat(name, F.lit(":"))).otherwise(F.concat(F.lit("\t "), name, F.lit(" ")))
    ref = F.concat(F.lit("country:"), name, F.lit(":x"))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("id"), identity.make_ref(kind, key).alias("ref"), identity.ref_error(kind, key).alias("error"), identity.corridor_ref(name, name, rail=F.lit("SWIFT")).alias("corridor"), identity.community_ref(F.lit("7"), n).alias("community"), identity.code_ref(F.concat(F.lit("a:"), name)).alias("code"), identity.ref_kind(ref).alias("parsed_kind"), identity.ref_key(ref).alias("parsed_key"))


@query("edge_ids", f"WITH {_TRADE} SELECT 'edge:TRADE:' || source || '→' || target || CASE WHEN n % 2 = 0 THEN ':' || n ELSE '' END AS id, n::BIGINT AS n FROM (SELECT *, s::VARCHAR AS source, t::VARCHAR AS target FROM trade)")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.sources.graphs import trade_edges

    disc = F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise(F.lit(" "))
    return trade_edges(spark, sf_dir).select(identity.edge_id(F.lit(" TRADE "), F.col("source").cast("string"), F.col("target").cast("string"), disc).alias("id"), "n")


@query("cache_keys", "SELECT c_custkey, 'v1|' || CASE WHEN c_custkey % 3 = 0 THEN 'public' ELSE 'member' END || '|raw|' || c_mktsegment || '|panel|7|2' AS key, c_custkey % 3 = 0 AS shared FROM customer")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    audience = F.when(F.col("c_custkey") % 3 == 0, "public").otherwise("member")
    key = identity.cache_key(audience, F.lit("raw"), "c_mktsegment", F.lit("panel"), F.lit("7"), F.lit("2"))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), identity.is_shared_cacheable(audience).alias("shared"))


@query("community_color_hash", f"WITH r AS (SELECT DISTINCT 'community:v7-' || c_mktsegment || '-' || c_nationkey AS ref FROM customer) SELECT ref, {_HASH.format('ref')} AS hash, {_PALETTE}[({_HASH.format('ref')} % 10 + 1)::INTEGER] AS color FROM r")
def community_color_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("community:v7-"), "c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("ref")).distinct()
    return refs.select("ref", identity.fnv1a("ref").alias("hash"), identity.community_color("ref").alias("color"))


@query("pii_scan", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bdid:[a-z0-9]+:') THEN 'did' ELSE 'email' END AS found FROM documents WHERE regexp_matches(text, '(?i)\bdid:[a-z0-9]+:') OR regexp_matches(text, '(?i)[^\s@]+@[^\s@]+\.[a-z]{2,}')")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", validate.sensitive(F.col("text")).alias("found")).where("found is not null")


def _faulty(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers and their orders as a payload with planted breaches; every 90th customer has its neighbour's id, and so its
    own orders dangle."""
    c = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    kind = F.when(c % 50 == 0, "member").otherwise("institution")
    measures = F.create_map(F.when(c % 40 == 0, "balance").otherwise("score"), F.col("c_acctbal"))
    label = F.when(c % 60 == 0, "x@y.org").when(c % 70 == 0, "did:key:z").otherwise(F.col("c_name"))
    nodes = customer.select(F.concat(kind, F.lit(":"), F.when(c % 90 == 0, c - 1).otherwise(c).cast("string")).alias("id"), kind.alias("kind"), label.alias("label"), measures.alias("measures"), F.when(c % 80 == 0, "money").alias("token_layer"), F.when(c % 30 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("x"), F.lit(2.0).alias("y"), F.when(c % 45 == 0, "guess").otherwise("real").alias("provenance"), c.alias("ord"))
    o = F.col("o_orderkey")
    owner = F.col("o_custkey")
    ref = F.concat(F.when(owner % 50 == 0, "member:").otherwise("institution:"), owner.cast("string"))
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), F.when(o % 200 == 0, o - 1).otherwise(o).cast("string")).alias("id"), ref.alias("source"), F.lit("institution:1").alias("target"), F.when(o % 150 == 0, "PVP_COMPLETE").when(o % 3 == 0, "route-executed").alias("settlement_state"), F.when(o % 170 == 0, "guess").otherwise("stale").alias("provenance"), o.alias("ord"))
    return nodes, edges


@query(
    "payload_violations",
    """WITH c AS (SELECT c_custkey AS c, c_name, CASE WHEN c_custkey % 50 = 0 THEN 'member' ELSE 'institution' END AS kind FROM customer),
  n AS (SELECT *, kind || ':' || CASE WHEN c % 90 = 0 THEN c - 1 ELSE c END AS id FROM c), d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c) AS k FROM n),
  e AS (SELECT o_orderkey AS o, 'e' || CASE WHEN o_orderkey % 200 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_custkey % 50 = 0 THEN 'member:' ELSE 'institution:' END || o_custkey AS source FROM orders),
  f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM e)
  SELECT 0 AS phase, c AS ord, rule, id AS entity FROM (
    SELECT c, id, 'identity:duplicate-node' AS rule FROM d WHERE k > 1 UNION ALL SELECT c, id, 'pii:member' FROM n WHERE kind = 'member'
    UNION ALL SELECT c, id, 'pii:label' FROM n WHERE c % 60 = 0 OR c % 70 = 0 UNION ALL SELECT c, id, 'provenance:node-provenance' FROM n WHERE c % 45 = 0
    UNION ALL SELECT c, id, 'confidential:measure' FROM n WHERE c % 40 = 0 UNION ALL SELECT c, id, 'confidential:token-layer' FROM n WHERE c % 80 = 0
    UNION ALL SELECT c, id, 'confidential:token-layer-not-allowed' FROM n WHERE c % 80 = 0 UNION ALL SELECT c, id, 'contract:position' FROM n WHERE c % 30 = 0)
  UNION ALL SELECT 1, o, rule, id FROM (
    SELECT o, id, 'identity:duplicate-edge' AS rule FROM f WHERE k > 1 UNION ALL SELECT o, id, 'contract:dangling' FROM e WHERE source NOT IN (SELECT id FROM n)
    UNION ALL SELECT o, id, 'provenance:edge-provenance' FROM e WHERE o % 170 = 0 UNION ALL SELECT o, id, 'confidential:settlement' FROM e WHERE o % 150 = 0)
  UNION ALL SELECT 2, 0, 'contract:legacy-ids', 'header'""",
)
def payload_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _faulty(spark, sf_dir)
    return validate.violations(nodes, edges, "public", positions=True, token_layers=["position"], legacy_ids=True).drop("rank")


@query("payload_header", "SELECT 'k' AS cache_key, 1 AS version, 'public' AS audience, 'panel' AS tier, 'curated' AS framing, NULL::BIGINT AS total_nodes, false AS sampled UNION ALL SELECT 'k', 1, 'member', 'panel', 'curated', (SELECT count(*) FROM nation), false")
def payload_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").count()
    both = [validate.header(spark, a, "panel", "curated", "k", n, n) for a in ("public", "member")]
    return both[0].unionByName(both[1]).select("cache_key", "version", "audience", "tier", "framing", "total_nodes", "sampled")


@query("dangling_edges", "SELECT o_orderkey::BIGINT AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(some, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("id"))


@query(
    "sanitized_slice",
    """WITH n AS (SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_suppkey % 10 != 0 GROUP BY 1)
  SELECT 'node' AS kind, count(*)::BIGINT AS n, sum(ord)::BIGINT AS check_sum FROM n UNION ALL SELECT 'edge', count(*), sum(l_orderkey) FROM lineitem WHERE l_suppkey % 10 != 0""",
)
def sanitized_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    nodes = line.select(F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).otherwise("").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    end = F.col("l_suppkey").cast("string")
    g = sanitized(Graph(nodes, line.select(end.alias("source"), end.alias("target"), "l_orderkey")))
    count = lambda df, kind, c: df.agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("check_sum")).select(F.lit(kind).alias("kind"), "n", "check_sum")
    return count(g.nodes, "node", "ord").union(count(g.edges, "edge", "l_orderkey"))


@query("counts_by_kind", "SELECT * FROM (SELECT c_mktsegment AS kind, count(*)::BIGINT AS n FROM customer GROUP BY 1 UNION ALL SELECT 'NOWHERE', 0 UNION ALL SELECT 'edges', (SELECT count(*) FROM orders))")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counts_by_kind(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "kind"), table(spark, sf_dir, "orders"), ["NOWHERE", "BUILDING"])


def _declared(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations as countries, segments as currencies, customers and suppliers that name them in properties."""
    props = lambda *kv: F.create_map(*kv).cast("map<string,string>")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Country").alias("kind"), F.col("n_name").alias("label"), props(F.lit("iso2"), F.concat(F.lit("X"), F.col("n_nationkey").cast("string"))).alias("props"), F.col("n_nationkey").cast("long").alias("ord"))
    segment = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("ord")).select(F.concat(F.lit("s"), "c_mktsegment").alias("id"), F.lit("Currency").alias("kind"), F.lower("c_mktsegment").alias("label"), props(F.lit("code"), F.col("c_mktsegment")).alias("props"), (F.col("ord") + 1000).alias("ord"))
    c = F.col("c_custkey")
    place = F.when(c % 2 == 0, F.concat(F.lit(" x"), F.col("c_nationkey").cast("string"))).otherwise("nowhere")
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("id"), F.when(c % 3 == 0, "FinancialInstitution").otherwise("Indicator").alias("kind"), F.col("c_name").alias("label"), props(F.lit("country"), place, F.lit("headquarters"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("currency"), F.col("c_mktsegment")).alias("props"), (c + 100000).alias("ord"))
    have = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("e"), c.cast("string")).alias("id"), F.concat(F.lit("c"), c.cast("string")).alias("source"), F.concat(F.lit("s"), "c_mktsegment").alias("target"), F.lit("USES_CURRENCY").alias("kind"))
    return Graph(nation.unionByName(segment).unionByName(customer), have)


@query(
    "prop_edges",
    """SELECT 'synth:' || source || ':' || target || ':' || kind AS id, source, target, kind FROM (
  SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, CASE WHEN c_custkey % 3 = 0 THEN 'HEADQUARTERED_IN' ELSE 'IN_COUNTRY' END AS kind FROM customer
  UNION ALL SELECT 'c' || c_custkey, 's' || c_mktsegment, 'USES_CURRENCY' FROM customer WHERE c_custkey % 10 != 0)""",
)
def prop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.property_edges(_declared(spark, sf_dir))


@query("kind_communities")
def kind_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    return communities.kind_communities(Graph(g.nodes.withColumn("kind", F.lit("Country")), sparse_graph(spark, sf_dir).edges))


@query("role_styles", """SELECT 'r' || n_nationkey AS ref, CASE WHEN n_nationkey % 5 = 0 THEN 'var(--fx-role-money)' WHEN n_nationkey % 5 = 1 THEN 'var(--fx-role-flow)' END AS own,
  CASE WHEN n_nationkey % 4 = 0 THEN """ + f"{_PALETTE}[({_HASH.format(chr(39) + 'community:v7-' + chr(39) + ' || n_regionkey')} % 10 + 1)::INTEGER]" + """ ELSE 'var(--fx-role-topology)' END AS over FROM nation""")
def role_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the source prop:roles, whose own role is passed over; and communities, empty ones too, over a rule's role."""
    n = F.col("n_nationkey")
    roles = F.when(n % 5 == 0, F.array(F.lit("money"), F.lit("flow"))).when(n % 5 == 1, F.array(F.lit("flow"))).when(n % 5 == 2, F.array(F.lit(""))).when(n % 5 == 3, F.array().cast("array<string>"))
    community = F.when(n % 4 == 0, F.concat(F.lit("community:v7-"), F.col("n_regionkey").cast("string"))).when(n % 4 == 1, "")
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("id"), roles.alias("roles"), community.alias("community"), F.lit("real").alias("provenance"), F.create_map().cast("map<string,double>").alias("measures"))
    own = styles.style_patches(nodes, (vocab.Rule("prop:roles", "color", "topology"),)).select("ref", F.col("color").alias("own"))
    over = styles.style_patches(nodes, (vocab.Rule("degree", "color", "topology"), vocab.Rule("community", "color"))).select("ref", F.col("color").alias("over"))
    return own.join(over, "ref")


@query("country_keys", "SELECT * FROM (VALUES ('bundesrepublik', '1'), ('germany', '1'), ('1', '1'), ('us', '3'), ('united states of america', '3'), ('2', '2'), ('usa', '2'), ('3', '3'), ('4', '4'), ('japan', '4'), ('jp', '4'), ('nippon', '4')) AS v(key, target)")
def country_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries whose label isn't their name, and a later one that takes an earlier one's code."""
    rows = [("1", "Germany", {"name": "Bundesrepublik"}, 1), ("2", "USA", {"iso2": "us"}, 2), ("3", "United States of America", {}, 3), ("4", "Nippon", {"name": "Japan"}, 4)]
    nodes = spark.createDataFrame(rows, "id string, label string, props map<string,string>, ord long").withColumn("kind", F.lit("Country"))
    return synthesis.country_index(nodes)


@query("partition_stats")
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.partition_stats(communities.partition(sparse_graph(spark, sf_dir)))


@query("precomputed_partition", "SELECT n_nationkey::VARCHAR AS id, ['#fbbc7a','#e87044','#5c7ad3','#aec2f8','#64be25','#d98cce','#c2a83e','#7a86a8'][(((n_regionkey - 2) % 8) + 8) % 8 + 1] AS color FROM nation WHERE n_nationkey % 4 != 0")
def precomputed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    value = F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_regionkey") - 2).cast("double"))
    nodes = nation.select(F.col("n_nationkey").cast("string").alias("id"), value.alias("community"))
    return communities.community_colors(communities.partition(Graph(nodes, sparse_graph(spark, sf_dir).edges)))


_WALK = """best AS (SELECT '{0}' AS node, 0.0::DOUBLE AS dist UNION ALL SELECT target, dist FROM (SELECT target, min(d) AS dist FROM walks WHERE target != '{0}' GROUP BY 1))"""
_WALKS = """walks AS (SELECT source, target, weight AS d, 1 AS hops FROM sparse WHERE source = '{0}'
  UNION SELECT s.source, s.target, min(w.d + s.weight), w.hops + 1 FROM walks w JOIN sparse s ON s.source = w.target WHERE w.hops < 24 GROUP BY s.source, s.target, w.hops)"""


@query("bellman_ford_dist", f"WITH RECURSIVE {_SPARSE}, {_WALKS.format('0')}, {_WALK.format('0')} SELECT node, round(dist, 6) AS dist FROM best")
def bellman_ford_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.distances(sparse_graph(spark, sf_dir), "0").select("node", *_six("dist"))


@query("best_route", f"WITH RECURSIVE {_SPARSE}, {_WALKS.format('0')}, {_WALK.format('0')}, far AS (SELECT min(target) AS t FROM sparse WHERE source = '0') SELECT round(dist, 6) AS total_weight, round(exp(-dist), 6) AS compounded_rate FROM best JOIN far ON node = t")
def best_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse_graph(spark, sf_dir)
    target = g.edges.where("source = '0'").agg(F.min("target").alias("t")).first()["t"]
    return registry.executed(registry.default_registry(), "cheapest-route", g, source="0", target=target).select(*_six("total_weight", "compounded_rate"))


@query("unreachable_route", "SELECT 0.0::DOUBLE AS total_weight WHERE false")
def unreachable_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse_graph(spark, sf_dir)
    return paths.route(Graph(g.nodes, g.edges.where("target != '7' and source != '7'")), "0", "7").select("total_weight")


@query(
    "eigenvector",
    f"""WITH RECURSIVE {_TRADE}, w AS (SELECT source, target, weight FROM edges WHERE source != target), u AS (SELECT source, target, sum(weight) AS w FROM (SELECT source, target, CASE WHEN weight > 0 THEN weight ELSE 1 END AS weight FROM w UNION ALL SELECT target, source, CASE WHEN weight > 0 THEN weight ELSE 1 END FROM w) GROUP BY ALL),
  x AS (SELECT n_nationkey::VARCHAR AS id, 0.2::DOUBLE AS v, 0 AS k FROM nation
    UNION ALL SELECT id, raw / sqrt(sum(raw * raw) OVER ()), k FROM (SELECT x.id, x.k + 1 AS k, x.v + coalesce((SELECT sum(u.w * y.v) FROM u JOIN x y ON y.id = u.source WHERE u.target = x.id), 0) AS raw FROM x WHERE x.k < 30))
  SELECT id AS node_id, round(v / max(v) OVER (), 4) AS value FROM x WHERE k = 30""",
)
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.eigenvector_centrality(nation_graph(spark, sf_dir), tolerance=1e-9).select("node_id", F.round("value", 4).alias("value"))


@query(
    "triangular_arbitrage",
    f"""WITH {_TRADE}, r AS (SELECT a.source, a.target, -ln(a.weight / b.weight * 0.999) AS c FROM edges a JOIN edges b ON a.source = b.target AND a.target = b.source WHERE a.source != a.target AND a.weight > 0 AND b.weight > 0)
  SELECT x.source || '>' || x.target || '>' || y.target || '>' || x.source AS path, round(x.c + y.c + z.c, 6) AS total_weight, round(exp(-(x.c + y.c + z.c)), 6) AS gain
  FROM r x JOIN r y ON x.target = y.source JOIN r z ON y.target = z.source AND z.target = x.source WHERE x.source < x.target AND x.source < y.target AND x.c + y.c + z.c < -1e-9""",
)
def triangular_arbitrage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = nation_graph(spark, sf_dir)
    back = g.edges.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("weight").alias("back"))
    rate = F.col("weight") / F.col("back") * 0.999
    edges = g.edges.where("source != target and weight > 0").join(back.where("back > 0"), ["source", "target"]).select("source", "target", scalars.edge_cost(F.lit(None).cast("double"), rate).alias("weight"))
    found = paths.negative_cycles(Graph(g.nodes, edges), 3).where(F.size("nodes") == 4)
    return found.select(F.array_join("nodes", ">").alias("path"), *_six("total_weight", "gain"))


_PEELED = """p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM {0} WHERE source != target), both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  peel AS (SELECT n_nationkey::VARCHAR AS id, k::INTEGER AS k, 0 AS step FROM nation, range(0, 26) r(k)
    UNION ALL SELECT id, k, step FROM (SELECT x.id, x.k, x.step + 1 AS step, (SELECT count(*) FROM both_ JOIN peel y ON y.id = both_.b AND y.k = x.k WHERE both_.a = x.id) AS d FROM peel x WHERE x.step < 26) WHERE d >= k),
  cores AS (SELECT id, max(k)::INTEGER AS core FROM peel WHERE step = 26 GROUP BY id)"""


@query("coreness", f"WITH RECURSIVE {_SPARSE}, {_PEELED.format('sparse')} SELECT id, core FROM cores")
def coreness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.coreness(sparse_graph(spark, sf_dir))


@query("core_periphery", f"WITH RECURSIVE {_TRADE}, {_PEELED.format('edges')} SELECT id, CASE WHEN core >= greatest(2, ceil((SELECT max(core) FROM cores) * 0.6)) THEN '{vocab.CORE['dark']}' ELSE '{vocab.PERIPHERY['dark']}' END AS color FROM cores")
def core_periphery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.core_periphery(communities.coreness(nation_graph(spark, sf_dir))).select("id", "color")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.floor(F.col("embedding")[i].cast("double") * 100000) / 100).alias
    return e.select(F.col("vec_id").alias("id"), at(0)("x"), at(1)("y"))


_POINTS = "points AS (SELECT vec_id AS id, floor(embedding[1]::DOUBLE * 100000) / 100 AS x, floor(embedding[2]::DOUBLE * 100000) / 100 AS y FROM embeddings)"


def _taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), (F.col("x") + 7).alias("qx"), (F.col("y") - 3).alias("qy"), F.lit(40.0).alias("radius"))


_TAPS = f"{_POINTS}, taps AS (SELECT id AS qid, x + 7 AS qx, y - 3 AS qy FROM points WHERE id % 20 = 0)"


@query("spatial_hits", f"WITH {_TAPS} SELECT qid, id, round((x - qx) * (x - qx) + (y - qy) * (y - qy), 4) AS d2 FROM taps, points WHERE (x - qx) * (x - qx) + (y - qy) * (y - qy) <= 1600")
def spatial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_near(_points(spark, sf_dir), _taps(spark, sf_dir)).select("qid", "id", F.round("d2", 4).alias("d2"))


@query("nearest_node", f"WITH {_TAPS}, h AS (SELECT qid, id, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS d2 FROM taps, points) SELECT qid, arg_min(id, (d2, id)) AS id FROM h WHERE d2 <= 48.0 * 48.0 GROUP BY qid")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.node_hits(_points(spark, sf_dir), _taps(spark, sf_dir).drop("radius"), 0.5).select("qid", "id")


_SEGMENTS = f"{_TAPS}, segs AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.id = a.id + 1)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    edges = p.select("id", F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return incremental.edge_geometry(edges, p)


_D2 = "(qx - (x1 + t * (x2 - x1))) ** 2 + (qy - (y1 + t * (y2 - y1))) ** 2"
_HITS = f"{_SEGMENTS}, k AS (SELECT *, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0 THEN greatest(0, least(1, ((qx - x1) * (x2 - x1) + (qy - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) ELSE 0 END AS t, greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 32))::BIGINT AS n FROM taps, segs), near AS (SELECT * FROM k WHERE {_D2} <= 1600), seen AS (SELECT DISTINCT qid, id, {_D2} AS d2 FROM (SELECT *, unnest(range(0, n + 1)) / n::DOUBLE AS u FROM near) WHERE floor((x1 + (x2 - x1) * u) / 64) BETWEEN floor((qx - 40) / 64) AND floor((qx + 40) / 64) AND floor((y1 + (y2 - y1) * u) / 64) BETWEEN floor((qy - 40) / 64) AND floor((qy + 40) / 64))"


@query("segment_hits", f"WITH {_HITS} SELECT qid, id, round(d2, 4) AS d2 FROM seen")
def segment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.segments_near(_segments(spark, sf_dir), _taps(spark, sf_dir)).select("qid", "id", F.round("d2", 4).alias("d2"))


@query("edge_hits", f"WITH {_HITS} SELECT qid, arg_min(id, (d2, id)) AS id FROM seen GROUP BY qid")
def edge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.edge_hits(_segments(spark, sf_dir), _taps(spark, sf_dir).drop("radius"), 0.3).select("qid", "id")


@query("world_bounds", f"WITH {_POINTS} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*)::BIGINT AS n FROM points")
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.world_bounds(_points(spark, sf_dir))


@query("minimap_projection", f"WITH {_POINTS}, b AS (SELECT min(x) AS a, min(y) AS b, max(x) - min(x) AS w, max(y) - min(y) AS h FROM points), s AS (SELECT *, least(136 / w, 80 / h) AS m FROM b) SELECT id, round((x - a) * m + (148 - w * m) / 2, 4) AS mx, round((y - b) * m + (92 - h * m) / 2, 4) AS my FROM points, s")
def minimap_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.minimap(_points(spark, sf_dir)).select("id", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


@query(
    "map_jumps",
    f"""WITH {_POINTS}, b AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM points), s AS (SELECT *, least(136 / (c - a), 80 / (d - b)) AS m FROM b)
  SELECT id AS pid, round(least(c, greatest(a, (id % 149 - (148 - (c - a) * m) / 2) / m + a)), 6) AS x, round(least(d, greatest(b, (id % 93 - (92 - (d - b) * m) / 2) / m + b)), 6) AS y FROM points, s""",
)
def map_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    presses = p.select(F.col("id").alias("pid"), (F.col("id") % 149).cast("double").alias("mx"), (F.col("id") % 93).cast("double").alias("my"))
    return aggregates.map_jumps(p, presses).select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("fit_camera", f"WITH {_POINTS}, b AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM points) SELECT round(2 * least(1.5, greatest(0.02, least(688 / greatest(c - a, 1), 544 / greatest(d - b, 1)))), 6) AS scale, round((a + c) / 2, 6) AS pan_x, round((b + d) / 2, 6) AS pan_y FROM b")
def fit_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fitted_camera(_points(spark, sf_dir), 800.0, 656.0, 2.0).select(*_six("scale", "pan_x", "pan_y"))


@query("screen_positions", f"WITH {_POINTS}, s AS (SELECT id, 0.5 * (x - 10) + 400 AS sx, 0.5 * (y + 20) + 300 AS sy FROM points) SELECT id, round(sx, 4) AS sx, round(sy, 4) AS sy FROM s")
def screen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = scalars.css_scale(F.lit(1.0), F.lit(2.0))
    to = lambda c, pan, extent: F.round(scalars.world_to_screen(F.col(c), F.lit(pan), F.lit(extent), scale), 4)
    return _points(spark, sf_dir).select("id", to("x", 10.0, 800.0).alias("sx"), to("y", -20.0, 600.0).alias("sy"))


@query("merged_positions", f"WITH {_POINTS} SELECT id, CASE WHEN id % 3 = 0 THEN x + 1 ELSE x END AS x, CASE WHEN id % 3 = 0 THEN y - 1 ELSE y END AS y FROM points")
def merged_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    live = p.where("id % 3 = 0").select("id", (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"))
    return incremental.merged_positions(p, live)


@query("stored_positions", f"WITH {_POINTS} SELECT id::VARCHAR AS ref, CASE WHEN id % 3 = 0 THEN x + 1 ELSE x END AS x, y FROM points WHERE id % 2 = 0 OR id % 3 = 0")
def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select(F.col("id").cast("string").alias("ref"), "id", "x", "y")
    return incremental.stored_positions(p.where("id % 2 = 0").select("ref", "x", "y"), p.where("id % 3 = 0").withColumn("x", F.col("x") + 1))


@query("incident_edges", f"WITH {_TRADE} SELECT source AS ref, source || '-' || target AS edge_id FROM edges UNION SELECT target, source || '-' || target FROM edges")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.incident_edges(nation_graph(spark, sf_dir).edges.withColumn("id", F.concat_ws("-", "source", "target")))


@query(
    "edge_flips",
    """SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS selected, CASE WHEN o_orderkey % 3 = 0 THEN '#e87044' ELSE o_orderpriority END AS color, CASE WHEN o_orderkey % 3 = 0 THEN 2.5::DOUBLE ELSE 1.25::DOUBLE END AS width
  FROM orders WHERE (o_orderkey % 2 = 0) != (o_orderkey % 3 = 0)""",
)
def edge_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("color"), F.lit(1.25).alias("width"))
    return incremental.edge_flips(base.where("id % 2 = 0"), base.where("id % 3 = 0"), base)


@query(
    "camera_moves",
    f"""WITH {_POINTS}, z AS (SELECT *, least(8.0, greatest(0.05, 0.5 * exp(-0.0015 * x))) AS after FROM points)
  SELECT id, round(after, 6) AS after, round((x - 400) / 0.5 + 10 - (x - 400) / after, 6) AS pan, round(10 - y / 0.5, 6) AS panned, round(x + (y - x) * (1 - (1 - least(1, id / 320)) ** 3), 6) AS eased, round(CASE WHEN x > 0 THEN abs(y) / x ELSE 1 END, 6) AS pinch FROM z""",
)
def camera_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, scale, pan, pane = F.col("x"), F.col("y"), F.lit(0.5), F.lit(10.0), F.lit(800.0)
    p = _points(spark, sf_dir).withColumn("after", scalars.zoom_around(scale, scalars.zoom_factor(x)))
    moved = {"after": F.round("after", 6), "pan": F.round(scalars.pan_after_zoom(x, pan, pane, scale, F.col("after")), 6), "panned": F.round(scalars.pan_by(pan, y, scale), 6)}
    moved |= {"eased": F.round(scalars.eased(x, y, F.col("id").cast("double")), 6), "pinch": F.round(scalars.pinch_factor(x, F.abs(y)), 6)}
    return p.select("id", *(c.alias(k) for k, c in moved.items()))


@query("selected_edges", f"WITH {_TRADE} SELECT DISTINCT source || '-' || target AS edge_id FROM edges WHERE source IN ('1', '2') OR target IN ('1', '2')")
def selected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nation_graph(spark, sf_dir).edges.withColumn("id", F.concat_ws("-", "source", "target"))
    return incremental.edges_of_selection(edges, spark.createDataFrame([("1",), ("2",)], "id string"))


@query("selection_flips", "SELECT c_custkey AS id, c_custkey % 3 = 0 AS selected FROM customer WHERE (c_custkey % 2 = 0) != (c_custkey % 3 = 0)")
def selection_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return incremental.selection_flips(ids.where("id % 2 = 0"), ids.where("id % 3 = 0"))


@query("label_placement")
def label_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    far = F.create_map(F.lit("magnitude"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))  # the vectors themselves all have length 1
    nodes = points.select("id", F.concat(F.lit("label "), "id").alias("label"), F.lit(None).cast("string").alias("label_quality"), far.alias("measures"), "x", "y")
    layer = labels.label_layer(nodes, points.select("id", "x", "y"), 200)
    found = labels.candidates(layer, 0.5, (0.0, 0.0), (800.0, 600.0))
    return labels.placed_labels(found)


@query("slice_layout")
def slice_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse_graph(spark, sf_dir)
    nodes = g.nodes.select("id", "ord", F.concat(F.lit("region-"), "region").alias("community_id"), F.lit("Country").alias("kind"))
    placed = layout.force_layout(nodes, g.edges, ticks=60)
    close = layout.close_layout(placed, g.edges, ticks=60).select("id", F.col("x").alias("close_x"), F.col("y").alias("close_y"))
    return placed.join(close, "id", "left")


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user, with milliseconds and a tie-break."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("double")
    return table(spark, sf_dir, "events").select("user_id", ms.alias("t"), F.col("event_id").alias("seq"), "event_type", "value")


@query(
    "throttle_events",
    """WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
  w AS (SELECT user_id, t, i, t AS last, true AS emit FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.t, e.i, CASE WHEN e.t - w.last >= 3600000 THEN e.t ELSE w.last END, e.t - w.last >= 3600000 FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
  SELECT user_id, t FROM w WHERE emit""",
)
def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.folded(_moments(spark, sf_dir), "user_id", machines.throttle(3_600_000)).select("user_id", "t")


@query(
    "tap_classes",
    """WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE AS t, event_id, value AS x FROM events),
  a AS (SELECT user_id, t, event_id * 2 AS seq, 'down' AS action, x FROM e UNION ALL SELECT user_id, t + event_id % 700, event_id * 2 + 1, 'up', x FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) AS i FROM a),
  s AS (SELECT user_id, t, i, CASE WHEN action = 'down' THEN x END AS down_x, CASE WHEN action = 'down' THEN t END AS down_t, NULL::DOUBLE AS last_x, NULL::DOUBLE AS last_t, NULL::VARCHAR AS outcome FROM o WHERE i = 1
    UNION ALL SELECT user_id, t, i, CASE WHEN action = 'down' THEN x END, CASE WHEN action = 'down' THEN t END,
      CASE WHEN what = 'tap' THEN x WHEN what = 'double' THEN NULL ELSE last_x END, CASE WHEN what = 'tap' THEN t WHEN what = 'double' THEN NULL ELSE last_t END, what
    FROM (SELECT o.user_id, o.t, o.i, o.action, o.x, s.last_x, s.last_t, CASE WHEN o.action = 'down' OR s.down_t IS NULL OR o.t - s.down_t > 500 THEN NULL
        WHEN s.last_t IS NOT NULL AND o.t - s.last_t <= 300 AND 2 * (o.x - s.last_x) ** 2 <= 256 THEN 'double' ELSE 'tap' END AS what
      FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1))
  SELECT user_id, t, outcome FROM s WHERE outcome IS NOT NULL""",
)
def tap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _moments(spark, sf_dir).withColumn("x", F.col("value")).withColumn("y", F.col("value"))
    down = e.withColumn("action", F.lit("down")).withColumn("seq", F.col("seq") * 2)
    up = e.withColumn("action", F.lit("up")).withColumn("t", F.col("t") + F.col("seq") % 700).withColumn("seq", F.col("seq") * 2 + 1)
    return machines.folded(down.unionByName(up), "user_id", machines.taps())


@query(
    "overlay_states",
    """WITH e AS (SELECT user_id, (epoch_us(ts) // 1000)::DOUBLE AS t, event_id AS seq, event_type IN ('click', 'view') AS tap FROM events),
  f AS (SELECT *, lag(tap) OVER (PARTITION BY user_id ORDER BY t, seq) AS prev FROM e)
  SELECT user_id, t, CASE WHEN tap THEN 'active' ELSE 'preview' END AS state, tap != coalesce(prev, false) AS consumed FROM f""",
)
def overlay_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type").isin("click", "view"), "tap").otherwise("esc")
    return machines.folded(_moments(spark, sf_dir).withColumn("event", event), "user_id", machines.overlay("panel"))


@query("settle_actions", "SELECT event_id, value > 0 AND false AS unused, NOT (event_id % 3 = 0) AND event_id % 2 = 0 OR (event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 5 != 0 AND event_id * 7 >= 8000) AS adopt, event_id % 3 != 0 AS done FROM events")
def settle_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    act = machines.settle_action(i % 2 == 0, i % 3 == 0, i % 5 == 0, i * 7)
    return table(spark, sf_dir, "events").select(i, F.lit(False).alias("unused"), act["adopt"].alias("adopt"), act["done"].alias("done"))


@query(
    "quiescence",
    """WITH e AS (SELECT user_id, (epoch_us(ts) // 1000 * 1000 + event_id % 1000)::DOUBLE AS t, event_id, CASE WHEN event_id < 4000 THEN event_id::DOUBLE ELSE 1.0 END AS x FROM events),
  m AS (SELECT *, coalesce(abs(x - lag(x) OVER o) > 0.01, true) AS moved FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t)),
  i AS (SELECT *, sum(moved::INTEGER) OVER (PARTITION BY user_id ORDER BY t) AS island FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY t) - 1 AS run FROM i)
  SELECT user_id, t, max((run >= 10)::INTEGER) OVER (PARTITION BY user_id ORDER BY t) = 0 AS moving FROM r""",
)
def quiescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _moments(spark, sf_dir).withColumn("t", F.col("t") * 1000 + F.col("seq") % 1000)
    x = F.when(F.col("seq") < 4000, F.col("seq").cast("double")).otherwise(1.0)
    return machines.still_runs(e.select("user_id", "t", x.alias("x"), F.lit(0.0).alias("y")), "user_id").select("user_id", "t", "moving")


@query("trace_ring", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 40")
def trace_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("t"))
    return machines.latest(rows, "user_id", 40).select("user_id", "event_id")


@query("venue_decisions", "SELECT * FROM (VALUES ('cheapest-route', 100, 'client-ts'), ('cheapest-route', 30000, 'server-query'), ('cheapest-route', 100000, NULL), ('eigenvector-centrality', 100, 'client-ts'), ('eigenvector-centrality', 30000, 'precomputed-cron'), ('eigenvector-centrality', 100000, 'precomputed-cron'), ('negative-cycles', 100, 'client-ts'), ('negative-cycles', 30000, 'server-query'), ('negative-cycles', 100000, NULL)) AS v(algorithm, nodes, venue)")
def venue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(a.id, n, registry.chosen_venue(a, n).venue) for a in registry.default_registry().rows() for n in (100, 30_000, 100_000)]
    return spark.createDataFrame(rows, "algorithm string, nodes int, venue string")


@query("tier_budgets", "SELECT * FROM (VALUES ('peek', 60, 20), ('chip', 60, 20), ('tile', 200, 40), ('drawer', 300, 80), ('panel', 2000, 120), ('workbench', 10000, 200), ('atlas', 50000, 200)) AS v(tier, max_nodes, label_budget)")
def tier_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.budget_table(spark).select("tier", "max_nodes", "label_budget")


@query("lens_catalog", "SELECT * FROM (VALUES ('raw', 'workbench', 200, 1), ('communities', 'workbench', 200, 2), ('core-periphery', 'workbench', 200, 1), ('fx-correlation', 'workbench', 200, 1), ('fx-mst', 'workbench', 200, 1), ('fx-pmfg', 'workbench', 200, 1), ('fx-arbitrage', 'workbench', 200, 1), ('fx-route', 'workbench', 200, 1), ('public-overview', 'panel', 80, 2), ('fibo', 'workbench', 200, 2), ('org', 'workbench', 200, 2), ('provenance', 'workbench', 200, 2), ('market', 'panel', 80, 2), ('ego', 'panel', 200, 2)) AS v(lens, tier, label_budget, n_rules)")
def lens_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.lens_table(spark).select("lens", "tier", "label_budget", "n_rules")


@query("legend_rows", "SELECT * FROM (VALUES ('size', NULL, 'Size = connections'), ('role', 'money', 'Money'), ('role', 'flow', 'Flow')) AS v(encoding, role, label)")
def legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.legend_table(spark).where("lens = 'market'").select("encoding", "role", "label")
