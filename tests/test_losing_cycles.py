import math

import pytest

from lattica.operators import paths
from lattica.plans import registry
from tests.test_operators import graph


@pytest.mark.parametrize("size", [3, 6])
def test_registry_finds_losing_cycles_of_any_length(spark, size):
    ring = [f"n{i}" for i in range(size)]
    edges = [(ring[i], ring[(i + 1) % size], 1.0 if i else -size - 1.0) for i in range(size)] + [("tail", "n2", 1.0), ("n1", "off", -50.0), ("n2", "n1", 40.0)]
    found = registry.executed(registry.default_registry(), "negative-cycles", graph(spark, [*ring, "tail", "off"], edges)).collect()
    assert [r["nodes"] for r in found] == [[*ring, "n0"]]
    assert found[0]["total_weight"] == -2 and found[0]["gain"] == math.exp(2)


def test_losing_cycle_of_none(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}", 1.0 if i else -5.0) for i in range(6)]
    assert paths.losing_cycle(graph(spark, [f"n{i}" for i in range(6)], ring)).count() == 0
    loop = graph(spark, ["a"], [("a", "a", -1.0)])
    assert paths.losing_cycle(loop).count() == 0 and paths.has_negative_cycle(loop)
