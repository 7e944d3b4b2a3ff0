"""The algorithm registry: rows of callables over graphs, and the choice of where they run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lattica.functions import vocab
from lattica.operators.centrality import eigenvector_centrality
from lattica.operators.paths import losing_cycles, route
from lattica.sources.graphs import Graph

UNBOUNDED = float("inf")
#: Nodes that a venue takes if an algorithm doesn't say; venues in order of preference; those there by default.
ENVELOPES = {"client-ts": 5_000, "server-query": 50_000, "precomputed-cron": UNBOUNDED, "server-native": UNBOUNDED}
PREFERENCE = ["client-ts", "server-query", "precomputed-cron", "server-native"]
AVAILABLE = ["client-ts", "server-query", "precomputed-cron"]


class RegistrationError(ValueError):
    """A row that the registry doesn't take."""


class DuplicateAlgorithmError(RegistrationError):
    """A row whose id is taken."""


@dataclass(frozen=True)
class Parameter:
    """What a parameter is; descriptive only."""

    name: str
    kind: str
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Algorithm:
    """A named function from a graph to a result table of one kind."""

    id: str
    family: str
    kind: str
    run: Callable[..., DataFrame]
    channel: str = "none"
    venues: tuple[str, ...] = ("client-ts",)
    envelopes: dict = field(default_factory=dict)
    parameters: tuple[Parameter, ...] = ()
    guard: str | None = None


class Registry:
    """Algorithms by id, in order of registration. A row with a guard needs an approver that approves it."""

    def __init__(self, approve: Callable[[str], bool] | None = None):
        self._rows: dict[str, Algorithm] = {}
        self._approve = approve

    def register(self, row: Algorithm) -> "Registry":
        if row.id in self._rows:
            raise DuplicateAlgorithmError(row.id)
        if row.guard is not None and not (self._approve and self._approve(row.guard)):
            raise RegistrationError(f"{row.id}: guard {row.guard} isn't approved")
        self._rows[row.id] = row
        return self

    def register_all(self, rows) -> "Registry":
        """One after the other: rows before a refused one stay."""
        for row in rows:
            self.register(row)
        return self

    def __contains__(self, name: str) -> bool:
        return name in self._rows

    def __len__(self) -> int:
        return len(self._rows)

    def get(self, name: str) -> Algorithm | None:
        return self._rows.get(name)

    def rows(self, family: str | None = None) -> list[Algorithm]:
        return [r for r in self._rows.values() if family is None or r.family == family]

    def families(self) -> list[str]:
        return list(dict.fromkeys(r.family for r in self._rows.values()))


BUILT_IN = (
    Algorithm("cheapest-route", "fx-routing", "paths", lambda graph, source, target: route(graph, source, target), "foreground", ("client-ts", "server-query"), {"client-ts": 20_000}, (Parameter("source", "nodeId", True), Parameter("target", "nodeId", True))),
    Algorithm("eigenvector-centrality", "centrality", "scores", lambda graph, max_iterations=100, tolerance=1e-6: eigenvector_centrality(graph, max_iterations, tolerance), "brightness", ("client-ts", "precomputed-cron", "server-native"), {"client-ts": 20_000}, (Parameter("max_iterations", "number", default=100), Parameter("tolerance", "number", default=1e-6))),
    Algorithm("negative-cycles", "cycle", "cycles", lambda graph, longest=4: losing_cycles(graph, longest), "edge-pulse", ("client-ts", "server-query"), {}, (Parameter("longest", "number", default=4),)),
)


def default_registry(approve: Callable[[str], bool] | None = None) -> Registry:
    return Registry(approve).register_all(BUILT_IN)


@dataclass(frozen=True)
class Decision:
    """A venue, or a refusal with its reason."""

    venue: str | None
    reason: str

    @property
    def refused(self) -> bool:
        return self.venue is None


def chosen_venue(row: Algorithm, nodes: int, available: list[str] | None = None) -> Decision:
    """The first preferred venue that the row declares, the deployment has and whose envelope holds the nodes."""
    there = AVAILABLE if available is None else available
    open_ = [v for v in PREFERENCE if v in row.venues and v in there]
    for venue in open_:
        if nodes <= row.envelopes.get(venue, ENVELOPES[venue]):
            return Decision(venue, f"{nodes} nodes fit {venue}")
    return Decision(None, f"{row.id}: {nodes} nodes fit none of {open_}" if open_ else f"{row.id}: no venue is available")


def executed(registry: Registry, name: str, graph: Graph, **parameters) -> DataFrame:
    """A registered algorithm's result over a graph."""
    row = registry.get(name)
    if row is None:
        raise KeyError(name)
    return row.run(graph, **parameters)


assert set(ENVELOPES) == set(vocab.VENUES)
