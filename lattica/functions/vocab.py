"""Closed vocabularies, budgets, palettes and the lens catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Vocabularies that payloads are checked against.
NODE_KINDS = "currency institution country corridor star member concept citation community circle role domain code indicator token asset cbdc partner fibo constellation".split()
AUDIENCES = ["public", "member", "operator"]
PROVENANCES = ["real", "illustrative", "stale", "unmeasured"]
MEASURES = ["count", "degree", "rate", "cost-bps", "volume-usd-observed", "capacity", "score", "magnitude", "freshness"]
SETTLEMENT_STATES = ["proof-of-funds-recorded", "route-executed", "partner-reported", "chain-confirmed"]
TOKEN_LAYERS = ["position", "settlement", "work", "knowledge"]
DATA_ROLES = ["money", "flow", "governance", "topology", "compliance"]
NODE_STATUSES = ["active", "proposal", "contested", "pending", "superseded"]
FRAMINGS = ["curated", "community", "sampled", "full"]
VENUES = ["client-ts", "server-query", "precomputed-cron", "server-native"]

# Tier, most nodes, label budget.
TIER_BUDGETS = {"peek": (60, 20), "chip": (60, 20), "tile": (200, 40), "drawer": (300, 80), "panel": (2000, 120), "workbench": (10000, 200), "atlas": (50000, 200)}
#: Which of a tier's two budgets were measured, and when; the others are provisional.
MEASURED = {("tile", "nodes"): "2026-07-08", ("drawer", "labels"): "2026-06-20", ("panel", "nodes"): "2026-07-15", ("panel", "labels"): "2026-06-20", ("workbench", "nodes"): "2026-07-15", ("workbench", "labels"): "2026-07-15", ("atlas", "nodes"): "2026-07-15", ("atlas", "labels"): "2026-07-15"}

# Palettes; the first by hash of a community's ref, the second by a community's number.
REF_PALETTE = ["#fbbc7a", "#e87044", "#64be25", "#aec2f8", "#5c7ad3", "#c8894a", "#f4a07f", "#3f7d17", "#7f97d0", "#8fa6e6"]
NUMBER_PALETTE = ["#fbbc7a", "#e87044", "#5c7ad3", "#aec2f8", "#64be25", "#d98cce", "#c2a83e", "#7a86a8"]
CORE = {"dark": "#ad5700", "light": "#fbbc7a"}
PERIPHERY = {"dark": "#546cb7", "light": "#aec2f8"}
SLICE_TONE, SLICE_COLOR, SLICE_STRONG = "blue", "#aec2f8", "#546cb7"


@dataclass(frozen=True)
class Rule:
    """One style rule: a source bound to a visual channel."""

    source: str
    channel: str
    role: str | None = None


@dataclass(frozen=True)
class Lens:
    """A row of the lens catalog."""

    id: str
    audience: str
    tier: str
    scope: str
    label_budget: int
    node_kinds: tuple[str, ...]
    rel_types: tuple[str, ...]
    rules: tuple[Rule, ...]
    legend: tuple[tuple[str, str | None, str], ...] = ()
    rank_measure: str | None = None
    token_layers: tuple[str, ...] = ()


_BENCH = tuple(k for k in NODE_KINDS if k not in ("member", "code"))
_SIZE, _ROLES = Rule("degree", "size"), Rule("prop:roles", "color")
_LINKS = ("size", None, "Size = connections")
_LINEAGE = ("SUPERSEDES", "SUPERSEDED_BY", "SUCCEEDED_BY", "MERGES_FROM", "DEDUPS_TO", "PROMOTED_FROM", "PROMOTED_FROM_ARCHIVE", "DERIVED_FROM")


def _fx(name: str, rel: str) -> Lens:
    return Lens(name, "member", "workbench", "fx", 200, ("currency",), (rel,), (_SIZE,), (_LINKS,))


# The lens catalog.
LENSES = {
    x.id: x
    for x in (
        Lens("raw", "member", "workbench", "network", 200, _BENCH, (), (_SIZE,), (_LINKS,)),
        Lens("communities", "member", "workbench", "network", 200, _BENCH, (), (Rule("prop:louvainCommunity", "color", "topology"), Rule("community", "color")), (("community", None, "Color = community"),)),
        Lens("core-periphery", "member", "workbench", "network", 200, _BENCH, (), (Rule("degree", "brightness"),), (("brightness", None, "Bright = core, dim = periphery"),)),
        _fx("fx-correlation", "CORRELATED"),
        _fx("fx-mst", "MST_LINK"),
        _fx("fx-pmfg", "PMFG_LINK"),
        _fx("fx-arbitrage", "ARB_HOP"),
        _fx("fx-route", "ROUTE_HOP"),
        Lens("public-overview", "public", "panel", "overview", 80, ("community",), ("GRAPH_COMMUNITY_LINK",), (Rule("count", "size"), _ROLES), (("size", None, "Size = entities inside"), *(("role", r, r.capitalize()) for r in DATA_ROLES)), "count"),
        Lens("fibo", "member", "workbench", "fibo", 200, ("fibo",), ("SUBCLASS_OF",), (_ROLES, _SIZE), (_LINKS, ("role", "money", "Financial ontology"))),
        Lens("org", "member", "workbench", "org", 200, ("circle", "role", "domain"), ("PARENT_OF", "HAS_ROLE", "OWNS_DOMAIN", "ACCOUNTABLE_FOR"), (_ROLES, _SIZE), (_LINKS, ("role", "governance", "Governance structure"))),
        Lens("provenance", "member", "workbench", "provenance", 200, ("concept",), _LINEAGE, (_ROLES, _SIZE), (_LINKS, ("role", "topology", "Lineage"))),
        Lens("market", "public", "panel", "market", 80, ("currency", "corridor", "indicator", "asset"), ("CORRELATED", "QUOTES", "ROUTE_HOP"), (_ROLES, _SIZE), (_LINKS, ("role", "money", "Money"), ("role", "flow", "Flow"))),
        Lens("ego", "public", "panel", "ego", 200, ("cbdc", "country", "token", "currency", "institution", "fibo", "partner", "corridor"), ("IN_COUNTRY", "PEGS_TO", "QUOTED_IN", "USES_CURRENCY", "ISSUES_CURRENCY", "SUBCLASS_OF", "subClassOf", "VIA_PARTNER"), (_ROLES, _SIZE), (_LINKS, ("role", "money", "Money"), ("role", "flow", "Flow")), None, tuple(TOKEN_LAYERS)),
    )
}


def lens(lens_id: str) -> Lens | None:
    """The lens of that id, or None."""
    return LENSES.get(lens_id)


def is_known_lens(lens_id: str) -> bool:
    return lens_id in LENSES


class LensError(ValueError):
    """A lens that breaks a catalog rule."""


def check_lens(x: Lens, seed_depth: int = 0) -> Lens:
    """The lens itself, if its id isn't blank, its budget and seed depth aren't negative and it has a node kind."""
    if not x.id.strip():
        raise LensError("a lens needs an id")
    if x.label_budget < 0:
        raise LensError(f"{x.id}: negative label budget")
    if not x.node_kinds:
        raise LensError(f"{x.id}: no node kinds")
    if seed_depth < 0:
        raise LensError(f"{x.id}: negative seed depth")
    return x


def lens_table(spark: SparkSession) -> DataFrame:
    """The lens catalog, one row for each lens, in catalog order."""
    rows = [(i, x.id, x.audience, x.tier, x.scope, x.label_budget, len(x.rules), len(x.node_kinds), x.rank_measure) for i, x in enumerate(LENSES.values())]
    return spark.createDataFrame(rows, "ord int, lens string, audience string, tier string, scope string, label_budget int, n_rules int, n_kinds int, rank_measure string")


def legend_table(spark: SparkSession) -> DataFrame:
    """A row for each legend entry of each lens."""
    rows = [(x.id, i, *entry) for x in LENSES.values() for i, entry in enumerate(x.legend)]
    return spark.createDataFrame(rows, "lens string, ord int, encoding string, role string, label string")


def budget_table(spark: SparkSession) -> DataFrame:
    rows = [(t, n, b, MEASURED.get((t, "nodes")), MEASURED.get((t, "labels"))) for t, (n, b) in TIER_BUDGETS.items()]
    return spark.createDataFrame(rows, "tier string, max_nodes int, label_budget int, nodes_measured string, labels_measured string")
