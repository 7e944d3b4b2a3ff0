"""Queries run over their whole tables, not over a prefix of ids."""

import math

import pandas as pd
import pytest

from lattica.operators import labels
from lattica.plans import catalog, queries  # noqa: F401  registers them


def written(folder, **tables):
    for name, frame in tables.items():
        frame.to_parquet(folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture
def shop(tmp_path):
    """1,800 customers, and two orders of each."""
    customer = pd.DataFrame({"c_custkey": range(1, 1801), "c_name": [f"c{i}" for i in range(1, 1801)], "c_acctbal": 1.0})
    orders = pd.DataFrame({"o_orderkey": range(1, 3601), "o_custkey": [i % 1800 + 1 for i in range(3600)]})
    return written(tmp_path, customer=customer, orders=orders)


def test_payload_violations_of_all_customers(spark, shop):
    rows = catalog.QUERIES["payload_violations"](spark, shop).collect()
    of = lambda rule: {r["ord"] for r in rows if r["rule"] == rule}
    customers = range(1, 1801)
    assert of("pii:member") == {c for c in customers if c % 50 == 0}
    assert of("pii:label") == {c for c in customers if c % 60 == 0 or c % 70 == 0}
    assert of("provenance:node-provenance") == {c for c in customers if c % 45 == 0}
    assert of("confidential:measure") == {c for c in customers if c % 40 == 0}
    assert of("contract:position") == {c for c in customers if c % 30 == 0}
    assert of("identity:duplicate-node") == {c for c in customers if c % 90 == 0 and c % 50}
    assert of("contract:dangling") == {o + 1 for o in range(3600) if (o % 1800 + 1) % 90 == 0}


def test_label_placement_of_all_points(spark, tmp_path):
    """The budget goes to the farthest points, wherever their ids are; greedy placement as brute force does it."""
    vectors = [[((i * 37) % 601 - 300) / 1000, ((i * 91) % 401 - 200) / 1000] for i in range(500)]
    data = written(tmp_path, embeddings=pd.DataFrame({"vec_id": range(500), "embedding": vectors}))
    at = {str(i): [math.floor(v * 100000) / 100 for v in x] for i, x in enumerate(vectors)}
    top = sorted(at, key=lambda i: (-math.sqrt(at[i][0] ** 2 + at[i][1] ** 2), i))[:200]
    assert sum(int(i) >= 200 for i in top) > 50
    layer = spark.createDataFrame([(i, f"label {i}", k, *at[i], 12.5) for k, i in enumerate(top)], "id string, label string, rank int, x double, y double, anchor_radius double")
    kept = []
    for r in labels.candidates(layer, 0.5, (0.0, 0.0), (800.0, 600.0)).orderBy("rank").collect():
        if not any(r.rect["left"] < k["right"] and k["left"] < r.rect["right"] and r.rect["top"] < k["bottom"] and k["top"] < r.rect["bottom"] for _, k in kept):
            kept.append((r["id"], r.rect))
    rows = catalog.QUERIES["label_placement"](spark, data).collect()
    assert {r["id"] for r in rows} == {i for i, _ in kept} and any(int(r["id"]) >= 200 for r in rows)
    assert {r["id"]: r["rank"] for r in rows} == {i: top.index(i) for i, _ in kept}
