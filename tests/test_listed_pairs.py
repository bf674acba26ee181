"""Listed pairs go out where they are found; only pairs of coincident rows move again."""

import math
import random

import pytest

from lucidgraph.operators.crossing import crossing_pairs
from lucidgraph.operators.occlusion import node_occlusion_hll, occluded_pairs
from lucidgraph.plans import cells

from . import brute
from .test_brute_force import random_graph


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def cloud(seed, n):
    rng = random.Random(seed)
    return {f"v{i}": (rng.random(), rng.random()) for i in range(n)}


def test_close_pairs_meet_their_ids_once(make):
    _, layout = make(cloud(1, 50), [])
    # one join of points with points, none of pairs with ids
    assert joins(occluded_pairs(layout, 0.2)) == 1
    assert joins(node_occlusion_hll(layout, 0.2)) == 1


def test_crossing_pairs_meet_their_edges_once(make):
    positions = cloud(3, 40)
    pairs = [(f"v{i}", f"v{i + 20}") for i in range(20)]
    edges, layout = make(positions, pairs)
    found = crossing_pairs(layout, edges, 0.1)
    # pairs of cells with the points of either side
    assert joins(found) == 2
    assert found.count() == brute.strip_crossings(positions, pairs, 0.1)[0] > 0


@pytest.mark.parametrize("budget", [4, 64, 4_194_304])
def test_coincident_vertices_among_single_ones(make, monkeypatch, budget):
    monkeypatch.setattr(cells, "LIST_BUDGET", budget)
    positions = cloud(2, 40) | {f"w{i}": (0.5, 0.5) for i in range(7)} | {"x": (0.9, 0.9), "y": (0.9, 0.9)}
    _, layout = make(positions, [])
    got = [(r.u, r.v) for r in occluded_pairs(layout, 0.1).collect()]
    ids = sorted(positions)
    want = {(a, b) for a in ids for b in ids if a < b and math.dist(positions[a], positions[b]) < 0.2}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("budget", [4, 64, 4_194_304])
def test_copies_among_single_segments(make, monkeypatch, budget):
    monkeypatch.setattr(cells, "LIST_BUDGET", budget)
    graph = random_graph(5, m=120)
    edges, layout = make(*graph)
    want = brute.strip_crossings(*graph, 0.7)[0]
    assert crossing_pairs(layout, edges, 0.7).count() == want
