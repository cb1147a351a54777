import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomlog.llm import common


def brute(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(root[u], root[v])
            if root[u] != low or root[v] != low:
                root[u] = root[v] = low
                changed = True
    return root


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)), min_size=1, max_size=60))
def test_stars_match_brute_force(edges):
    u, v = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    node, root = common.stars(u, v)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: r for k, r in brute(edges).items() if k != r}


def graphs():
    rnd = random.Random(3)
    order = rnd.sample(range(400), 400)
    path = list(zip(order, order[1:], strict=False))
    hub = [(0, k) for k in range(1, 500)] + [(1000 + k, 1001 + k) for k in range(0, 60, 2)]
    loose = [(rnd.randrange(600), rnd.randrange(600)) for _ in range(350)]
    return {"path": path, "hub": hub, "loose": loose + loose[:20] + [(7, 7)]}


@pytest.mark.parametrize("name", ["path", "hub", "loose"])
@pytest.mark.parametrize("edges_a_chunk", [3, 50_000])
def test_components_match_brute_force(spark, monkeypatch, name, edges_a_chunk):
    """Small chunks leave nearly all of the work to the rounds; large ones to the contraction."""
    monkeypatch.setattr(common, "EDGES", edges_a_chunk)
    edges = graphs()[name]
    rows = common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    found = {r["node"]: r["root"] for r in rows}
    assert len(found) == len(rows)
    assert found == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
