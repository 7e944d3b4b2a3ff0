import math
import os

import pytest

from lattica.functions import vocab
from lattica.plans import catalog, queries  # noqa: F401  registers them
from lattica.sources.graphs import nation_graph
from tests.test_operators import naive_coreness

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_core_periphery_of_few_suppliers(spark):
    g = nation_graph(spark, DATA)
    core = naive_coreness([r["id"] for r in g.nodes.collect()], [(r["source"], r["target"], 1.0) for r in g.edges.collect()])
    limit = max(2, math.ceil(max(core.values()) * 0.6))
    expected = {x: vocab.CORE["dark"] if k >= limit else vocab.PERIPHERY["dark"] for x, k in core.items()}
    assert len(expected) == 25
    assert {r["id"]: r["color"] for r in catalog.QUERIES["core_periphery"](spark, DATA).collect()} == expected
