import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.functions import vocab
from lattica.operators import aggregates, centrality, communities, incremental, labels, layout, paths, spatial, styles, synthesis, validate
from lattica.plans import registry
from lattica.sources.graphs import Graph, sanitized
from lattica.sources.sinks import SinkError, TableSink, read_trace


def graph(spark, nodes, edges, rate=False):
    n = spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "id string, ord long")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(edges)], "source string, target string, weight double, ord long")
    return Graph(n, e.withColumn("weight", -F.log("weight")) if rate else e)


def test_route(spark):
    g = graph(spark, ["USD", "EUR", "GBP"], [("USD", "EUR", 0.9), ("EUR", "GBP", 0.85), ("USD", "GBP", 0.75)], rate=True)
    r = paths.route(g, "USD", "GBP").first()
    assert r["nodes"] == ["USD", "EUR", "GBP"] and r["hops"] == 2 and round(r["compounded_rate"], 4) == 0.765
    g = graph(spark, ["a", "b", "c", "island"], [("a", "b", 5.0), ("a", "c", 1.0), ("c", "b", 1.0)])
    r = paths.route(g, "a", "b").first()
    assert r["nodes"] == ["a", "c", "b"] and r["total_weight"] == 2
    assert paths.route(g, "a", "island").count() == 0
    assert paths.route(g, "a", "ghost").count() == 0
    assert paths.route(g, "a", "a").first()["hops"] == 0


@pytest.mark.parametrize(
    ("nodes", "edges", "rate", "total", "size"),
    [
        (["USD", "EUR", "GBP"], [("USD", "EUR", 0.9), ("EUR", "GBP", 0.85), ("GBP", "USD", 1.5)], True, -math.log(1.1475), 4),
        (["USD", "EUR", "GBP"], [("USD", "EUR", 0.9), ("EUR", "GBP", 0.85), ("GBP", "USD", 1.2)], True, None, 0),
        (["a", "b", "c"], [("a", "b", -2.0), ("b", "c", -3.0)], False, None, 0),
        (["a", "b", "c", "d"], [("a", "b", 2.0), ("b", "a", -3.0), ("b", "c", 1.0), ("c", "d", 1.0)], False, -1.0, 3),
        (["x", "y", "z"], [("x", "y", -1.0), ("y", "z", -1.0), ("z", "x", -1.0)], False, -3.0, 4),
        ([], [], False, None, 0),
    ],
)
def test_negative_cycles(spark, nodes, edges, rate, total, size):
    g = graph(spark, nodes, edges, rate)
    found = paths.negative_cycles(g).collect()
    assert len(found) == (total is not None)
    assert paths.has_negative_cycle(g) is (total is not None)
    if found:
        assert round(found[0]["total_weight"], 4) == round(total, 4) and len(found[0]["nodes"]) == size
        assert round(found[0]["gain"], 4) == round(math.exp(-total), 4)


def test_canonical_cycle(spark):
    rows = spark.createDataFrame([(["b", "c", "a"],), (["a", "b", "c"],)], "n array<string>").select(paths.canonical_cycle(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in rows] == [["a", "b", "c", "a"]] * 2


def test_centrality(spark):
    star = {r["node_id"]: r["value"] for r in centrality.eigenvector_centrality(graph(spark, ["hub", "a", "b", "c", "d"], [("hub", x, None) for x in "abcd"])).collect()}
    assert round(star["hub"], 5) == 1 and round(star["a"], 2) == 0.5
    weighted = {r["node_id"]: r["value"] for r in centrality.eigenvector_centrality(graph(spark, ["a", "b", "c"], [("a", "b", 10.0), ("b", "c", 1.0)])).collect()}
    assert weighted["b"] == 1 and weighted["a"] > weighted["c"]
    assert centrality.eigenvector_centrality(graph(spark, ["lonely"], [])).first()["value"] == 0
    assert centrality.eigenvector_centrality(graph(spark, [], [])).count() == 0


def naive_coreness(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b, _ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    core, k = {}, 0
    while near:
        n = min(near, key=lambda x: (len(near[x]), x))
        k = max(k, len(near[n]))
        core[n] = k
        for m in near.pop(n):
            near[m].discard(n)
    return core


def test_coreness(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), ("d", "d", 1.0), ("a", "b", 2.0)]
    found = {r["id"]: r["core"] for r in communities.coreness(graph(spark, list("abcde"), edges)).collect()}
    assert found == naive_coreness(list("abcde"), edges)
    colors = {r["id"]: r["color"] for r in communities.core_periphery(communities.coreness(graph(spark, list("abcde"), edges)), "light").collect()}
    assert colors["a"] == vocab.CORE["light"] and colors["d"] == vocab.PERIPHERY["light"]


def test_louvain(spark):
    cliques = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("a1", "b1")]
    found = communities.louvain(cliques)
    assert len(set(found.values())) == 2 and found["a1"] == found["a2"] == found["a3"] != found["b1"] == found["b2"] == found["b3"]
    assert communities.louvain(list(reversed(cliques))) == found
    assert communities.partition(graph(spark, ["solo"], [])).count() == 0


def test_communities_are_the_same_at_every_size(spark, monkeypatch):
    r = random.Random(5)
    cliques = {(f"{k}{i}", f"{k}{j}") for k in "ab" for i in range(4) for j in range(i)} | {("a0", "b0")}
    blocks = {tuple(sorted((f"n{i}", f"n{j}"))) for i in range(11) for j in range(i) if r.random() < (0.8 if i % 3 == j % 3 else 0.1)}
    kinds = {"cliques": cliques, "blocks": blocks, "star": {("hub", f"leaf{i}") for i in range(5)}}
    rows = [(k, min(p), max(p)) for k, pairs in kinds.items() for p in sorted(pairs)]
    monkeypatch.setattr(communities, "MOST_PAIRS", 4)
    found = communities._by_louvain(spark.createDataFrame(rows, "kind string, a string, b string")).collect()
    for kind, pairs in kinds.items():
        assert {x["id"]: x["community"] for x in found if x["kind"] == kind} == communities.louvain(sorted(pairs))
    parts = communities.louvain(sorted(cliques))
    assert {parts[f"a{i}"] for i in range(4)} == {0} and {parts[f"b{i}"] for i in range(4)} == {1}


def test_no_single_move_of_a_community_gains(spark):
    r = random.Random(6)
    for n in (6, 15, 40):
        pairs = sorted({(f"n{j:02}", f"n{i:02}") for i in range(n) for j in range(i) if r.random() < 0.2})
        parts = communities.louvain(pairs)

        def modularity(of, pairs=pairs):
            degree = Counter(x for p in pairs for x in p)
            volume = Counter()
            for x, c in of.items():
                volume[c] += degree[x]
            return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum(v * v for v in volume.values()) / (2 * len(pairs)) ** 2

        base = modularity(parts)
        numbers = sorted(set(parts.values()))
        assert numbers == list(range(len(numbers)))
        assert all(modularity({x: b if c == a else c for x, c in parts.items()}) <= base + 1e-9 for a in numbers for b in numbers)


def test_kind_communities(spark):
    nodes = spark.createDataFrame([(f"x{i}", "Big", i) for i in range(12)] + [(f"y{i}", "Small", i) for i in range(11)], "id string, kind string, ord long")
    edges = spark.createDataFrame([("x0", "x1"), ("x1", "x2"), ("x0", "x2"), ("y0", "y1")], "source string, target string")
    found = {r["id"]: r["community_id"] for r in communities.kind_communities(Graph(nodes, edges)).collect()}
    assert found["y0"] == "community-small" and found["x0"] == found["x1"] == found["x11"] == "community-big-0"
    assert communities.community_table(communities.kind_communities(Graph(nodes, edges))).agg(F.sum("size")).first()[0] == 23


def payload(spark, **changed):
    row = {"id": "currency:EUR", "kind": "currency", "label": "Euro", "measures": {"degree": 12.0, "cost-bps": None}, "token_layer": None, "x": 0.0, "y": 0.0, "provenance": "real", "ord": 0} | changed
    schema = "id string, kind string, label string, measures map<string,double>, token_layer string, x double, y double, provenance string, ord long"
    rows = [tuple(row[c.split()[0]] for c in schema.split(", ")), ("currency:BRL", "currency", "Real", None, None, 1.0, 1.0, "real", 1)]
    edges = spark.createDataFrame([("e", changed.get("source", "currency:EUR"), "currency:BRL", changed.get("state"), "real", 0)], "id string, source string, target string, settlement_state string, provenance string, ord long")
    return spark.createDataFrame(rows, schema), edges


@pytest.mark.parametrize(
    ("changed", "audience", "rule"),
    [
        ({}, "public", None),
        ({"label": "did:web:x"}, "operator", "pii:label"),
        ({"label": "a@b.org"}, "public", "pii:label"),
        ({"id": "member:a", "kind": "member", "source": "member:a"}, "member", "pii:member"),
        ({"id": "member:a", "kind": "member", "source": "member:a"}, "operator", None),
        ({"measures": {"balance": 1.0}}, "public", "confidential:measure"),
        ({"state": "PVP_COMPLETE"}, "public", "confidential:settlement"),
        ({"token_layer": "settlement"}, "public", "confidential:token-layer-not-allowed"),
        ({"id": "currency:BRL", "source": "currency:BRL"}, "public", "identity:duplicate-node"),
        ({"source": "currency:GBP"}, "public", "contract:dangling"),
        ({"x": None}, "public", "contract:position"),
        ({"provenance": "guess"}, "public", "provenance:node-provenance"),
    ],
)
def test_payload_rules(spark, changed, audience, rule):
    nodes, edges = payload(spark, **changed)
    found = validate.violations(nodes, edges, audience, positions=True, token_layers=["position"]).orderBy("phase", "ord", "rank").collect()
    assert (found[0]["rule"] if found else None) == rule
    if rule:
        with pytest.raises(validate.PayloadError, match=rule):
            validate.checked(nodes, edges, audience, positions=True, token_layers=["position"])


def test_gates(spark):
    with pytest.raises(validate.PayloadError, match="budget"):
        validate.gate(spark.range(61), "peek")
    assert validate.gate(spark.range(60), "peek") == 60
    assert validate.layout_for(True, 10**6) == "free" and validate.layout_for(False, 2000) == "d3Force"
    with pytest.raises(validate.PayloadError, match="layout"):
        validate.layout_for(False, 2001)
    assert validate.is_trivial_partition(1, 5) and validate.is_trivial_partition(5, 5) and not validate.is_trivial_partition(2, 5)


def test_labels(spark):
    rows = [("a", "x", "generic", {"count": 5000.0}), ("b", "x", "generic", {"count": 4000.0}), ("c", "C", None, {"count": 40.0}), ("d", "D", None, {"count": 30.0}), ("e", "x", "generic", {"count": 1.0}), ("f", "y", "generic", {"count": None, "degree": 9.0})]
    nodes = spark.createDataFrame(rows, "id string, label string, label_quality string, measures map<string,double>")
    assert [r["id"] for r in labels.picked_labels(nodes, 3, "count").orderBy("rank").collect()] == ["c", "d", "a"]
    assert [r["id"] for r in labels.picked_labels(nodes, 9, "count").orderBy("rank").collect()] == ["c", "d", "a", "b", "f"]
    assert labels.picked_labels(nodes, 0).count() == 0


def test_label_placement(spark):
    rows = [("a", "aaaa", 0, 0.0, 0.0), ("b", "bbbb", 1, 1.0, 1.0), ("c", "cccc", 2, 0.0, 200.0), ("d", "dddd", 3, float("nan"), 0.0)]
    found = labels.candidates(spark.createDataFrame(rows, "id string, label string, rank int, x double, y double").withColumn("anchor_radius", F.lit(5.0)), 1.0, (0.0, 0.0), (800.0, 600.0))
    placed = [r["id"] for r in labels.placed_labels(found).orderBy("rank").collect()]
    assert placed == ["a", "c"]
    assert sorted(r["id"] for r in labels.grouped_placement(found.withColumn("pane", F.lit(1)), "pane").collect()) == placed


def test_styles(spark):
    nodes = spark.createDataFrame([("a", {"degree": 16.0}, ["money"], None, "illustrative"), ("b", None, None, "community:v7-42", "real")], "id string, measures map<string,double>, roles array<string>, community string, provenance string")
    got = {r["ref"]: r for r in styles.style_patches(nodes, (vocab.Rule("prop:roles", "color"), vocab.Rule("community", "color"), vocab.Rule("degree", "size"))).collect()}
    assert got["a"]["color"] == "var(--fx-role-money)" and got["a"]["size"] == 8 and got["a"]["dashed"]
    assert got["b"]["color"] == vocab.REF_PALETTE[0] and got["b"]["size"] is None
    first = styles.style_patches(nodes, (vocab.Rule("degree", "size"),))
    assert styles.style_delta(first.limit(0), first).count() == 2
    assert styles.style_delta(first, first).count() == 0


def test_normalized(spark):
    rows = lambda *v: {r["id"]: r["norm"] for r in aggregates.normalized(spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "id string, value double")).collect()}
    assert rows(2.0, 4.0, 6.0) == {"0": 0, "1": 0.5, "2": 1}
    assert rows(5.0, 5.0) == {"0": 1, "1": 1} and rows(-5.0, -5.0) == {"0": 0, "1": 0}


def test_bounds(spark):
    nodes = spark.createDataFrame([("a", -100.0, 40.0), ("b", 300.0, -60.0), ("c", None, 1.0)], "id string, x double, y double")
    assert tuple(aggregates.world_bounds(nodes).first())[:4] == (-100, -60, 300, 40)
    assert aggregates.world_bounds(nodes.where("id = 'a'")).count() == 0
    square = spark.createDataFrame([(x, y) for x in (-300.0, 300.0) for y in (-300.0, 300.0)], "x double, y double")
    assert round(aggregates.fitted_camera(square, 800.0, 656.0, 2.0).first()["scale"], 6) == round(544 / 600 * 2, 6)


def test_spatial_joins_match_brute_force(spark):
    import random

    r = random.Random(5)
    points = [(i, r.uniform(-300, 300), r.uniform(-300, 300)) for i in range(200)]
    taps = [(i, r.uniform(-300, 300), r.uniform(-300, 300), r.choice([5.0, 40.0, 90.0])) for i in range(30)]
    found = {(x["qid"], x["id"]) for x in spatial.points_near(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(taps, "qid long, qx double, qy double, radius double")).collect()}
    assert found == {(q, i) for q, a, b, d in taps for i, x, y in points if (x - a) ** 2 + (y - b) ** 2 <= d * d}
    seg = spark.createDataFrame([("e1", 0.0, 0.0, 1000.0, 1000.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    tap = spark.createDataFrame([(1, 500.0, 508.0), (2, 500.0, 700.0)], "qid int, qx double, qy double")
    assert [x["qid"] for x in spatial.edge_hits(seg, tap, 1.0, 16.0).collect()] == [1]


def test_incremental(spark):
    old, new = spark.createDataFrame([("EUR",), ("BRL",)], "id string"), spark.createDataFrame([("EUR",), ("NGN",)], "id string")
    diff = incremental.element_diff(old, new)
    assert {tuple(r) for r in diff.collect()} == {("BRL", "remove"), ("EUR", "upsert"), ("NGN", "upsert")}
    assert {r["id"] for r in incremental.applied(old, diff, new).collect()} == {"EUR", "NGN"}
    edges = spark.createDataFrame([("1", "USD", "EUR"), ("2", "EUR", "JPY"), ("3", "JPY", "USD")], "id string, source string, target string")
    assert incremental.edges_of_selection(edges, spark.createDataFrame([("USD",)], "id string")).count() == 2
    assert incremental.edges_of_selection(edges, spark.createDataFrame([("USD",), ("EUR",)], "id string")).count() == 3
    assert {tuple(r) for r in incremental.selection_flips(old, new).collect()} == {("BRL", False), ("NGN", True)}
    assert {r["id"] for r in incremental.toggled(old, new).collect()} == {"BRL", "NGN"}


def test_session_keeps_drags(spark):
    sink = TableSink(spark, {"disable_telemetry": True})
    session = incremental.Session(sink)
    nodes = lambda *ids: spark.createDataFrame([(i, 10.0, 10.0) for i in ids], "id string, x double, y double")
    edges = spark.createDataFrame([], "id string, source string, target string")
    session.ingest(nodes("EUR", "BRL"), edges, "panel")
    session.override("EUR", 200.0, 300.0)
    session.ingest(nodes("EUR", "NGN"), edges, "panel")
    assert {r["id"]: (r["x"], r["y"]) for r in sink.positions().collect()} == {"EUR": (200, 300), "NGN": (10, 10)}
    session.clear_overrides(nodes("EUR"))
    assert sink.node("EUR").first()["x"] == 10 and sink.count("pin") == 1
    assert not session.override("EUR", float("nan"), 0.0) and session.status == "ready"
    session.destroy()
    with pytest.raises(validate.PayloadError, match="lifecycle"):
        session.ingest(nodes("EUR"), edges, "panel")
    with pytest.raises(SinkError):
        TableSink(spark, {"disable_telemetry": 1})
    assert read_trace(None) == [] and read_trace("{") == [] and read_trace('["a"]') == ["a"]


def test_sanitized(spark):
    nodes = spark.createDataFrame([("a", "first", 0), ("a", "second", 1), ("", "empty", 2), (None, "null", 3), ("b", "b", 4)], "id string, label string, ord long")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "ghost")], "source string, target string")
    clean = sanitized(Graph(nodes, edges))
    assert {(r["id"], r["label"]) for r in clean.nodes.collect()} == {("a", "first"), ("b", "b")} and clean.edges.count() == 2


def test_property_edges(spark):
    rows = [
        ("n1", "Country", "Brazil", {}, 0), ("n2", "Country", "Germany", {"iso2": "XX"}, 1), ("c1", "Currency", "Digital Real", {"code": "DREX"}, 2), ("a1", "Asset", "USDC", {"symbol": "USDC"}, 3), ("a2", "Asset", "DREX", {}, 4),
        ("i1", "Indicator", "gdp", {"country": " brazil "}, 5), ("i2", "Indicator", "cpi", {"country": "DE"}, 6), ("f1", "FinancialInstitution", "bank", {"country": "nowhere", "iso2": "xx", "currency": "drex"}, 7), ("p1", "Partner", "Circle", {"x": "y"}, 8), ("q", "Indicator", "none", None, 9),
    ]
    nodes = spark.createDataFrame(rows, "id string, kind string, label string, props map<string,string>, ord long")
    edges = spark.createDataFrame([("e", "i1", "n1", "IN_COUNTRY")], "id string, source string, target string, kind string")
    found = {(r["source"], r["target"], r["kind"]) for r in synthesis.property_edges(Graph(nodes, edges)).collect()}
    assert found == {("i2", "n2", "IN_COUNTRY"), ("f1", "n2", "HEADQUARTERED_IN"), ("f1", "c1", "USES_CURRENCY"), ("p1", "a1", "ISSUES_CURRENCY")}
    made = synthesis.built_slice(Graph(nodes, edges), ["Star"])
    assert made["nodes"].count() == 10 and made["edges"].count() == 5
    assert {r["kind"]: r["n"] for r in made["counts"].collect()}["Star"] == 0


def test_layouts(spark):
    g = graph(spark, list("abcde"), [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    nodes = g.nodes.withColumn("community_id", F.when(F.col("ord") < 2, "x").otherwise("y")).withColumn("kind", F.lit("k"))
    one, two = (sorted(map(tuple, layout.force_layout(nodes, g.edges, ticks=40).collect())) for _ in range(2))
    assert one == two and all(abs(v) < 500 for r in one for v in r[1:4])
    close = layout.close_layout(layout.force_layout(nodes, g.edges, ticks=40), g.edges, ticks=20).collect()
    assert {r["id"] for r in close} == set("abcd") and all(round(r["x"], 2) == r["x"] for r in close)


def test_registry(spark):
    r = registry.default_registry()
    assert len(r) == 3 and "negative-cycles" in r and r.families() == ["fx-routing", "centrality", "cycle"]
    with pytest.raises(registry.DuplicateAlgorithmError):
        r.register(registry.BUILT_IN[0])
    guarded = registry.Algorithm("g", "cycle", "cycles", lambda g: None, guard="k")
    with pytest.raises(registry.RegistrationError):
        r.register(guarded)
    assert "g" in registry.Registry(lambda k: k == "k").register(guarded)
    assert registry.chosen_venue(r.get("cheapest-route"), 100).venue == "client-ts"
    assert registry.chosen_venue(r.get("cheapest-route"), 30_000).venue == "server-query"
    assert registry.chosen_venue(r.get("cheapest-route"), 10**6).refused
    assert registry.chosen_venue(r.get("cheapest-route"), 1, []).refused
    scores = centrality.eigenvector_centrality(graph(spark, ["a", "b"], [("a", "b", 1.0)]))
    assert styles.encoded(scores, "scores", "size").first()["brightness"] is None
    assert styles.encoded(scores, "scores").first()["brightness"] is not None
