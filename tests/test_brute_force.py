"""Operators against plain definitions on awkward small graphs."""

import random

import pytest

from lucidgraph.operators.angles import minimum_angle
from lucidgraph.operators.crossing import (
    crossing_pairs,
    edge_crossing_angle,
    edge_crossing_by_strip,
    edge_crossing_strips,
)
from lucidgraph.operators.exact_crossing import edge_crossing_exact
from lucidgraph.operators.layout import repulsive_forces
from lucidgraph.operators.lengths import edge_length_variation
from lucidgraph.operators.occlusion import (
    node_occlusion,
    node_occlusion_grid,
    node_occlusion_hll,
    occluded_pairs,
)
from lucidgraph.operators.report import readability_report
from lucidgraph.plans import cells

from . import brute
from .conftest import by_trial, value


def grid_graph(seed, n=30, side=6, m=80, hub=False):
    """Vertices on a small integer grid: shared points, collinear, vertical and
    repeated edges, self-loops; with ``hub`` most edges meet in two vertices."""
    rng = random.Random(seed)
    positions = {f"v{i}": (float(rng.randrange(side)), float(rng.randrange(side))) for i in range(n)}
    ends = 2 if hub else n
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(ends)}") for _ in range(m)]
    return positions, edges


def random_graph(seed, n=40, m=90, scale=10.0):
    rng = random.Random(seed)
    positions = {f"v{i}": (rng.random() * scale, rng.random() * scale) for i in range(n)}
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)]
    return positions, edges


GRAPHS = [
    grid_graph(1),
    grid_graph(2, side=3, m=50),
    grid_graph(3, hub=True, side=12),
    random_graph(4),
]


@pytest.mark.parametrize("strips", [None, 6])
def test_exact_crossings(make_many, strips):
    edges, layout = make_many(GRAPHS)
    proper, meeting = zip(*(brute.crossings(*g) for g in GRAPHS))
    assert by_trial(edge_crossing_exact(layout, edges, True, strips)) == list(proper)
    assert by_trial(edge_crossing_exact(layout, edges, False, strips)) == list(meeting)


def test_strip_plans_agree(make_many):
    edges, layout = make_many(GRAPHS)
    counts, angles = zip(*(brute.strip_crossings(*g, 0.7) for g in GRAPHS))
    chunks = {"max_rows": 8, "chunk_rows": 20}
    for options in ({}, {"plan": "bitwise"}, chunks):
        assert by_trial(edge_crossing_strips(layout, edges, 0.7, **options)) == list(counts)
    for options in ({}, chunks):
        got = by_trial(edge_crossing_angle(layout, edges, g=0.7, **options))
        assert got == pytest.approx(list(angles))


def test_strips_approach_the_exact_count(make):
    edges, layout = make(*random_graph(11))
    counts = [value(edge_crossing_strips(layout, edges, g)) for g in (2.0, 0.5, 0.02)]
    exact = value(edge_crossing_exact(layout, edges, proper=True))
    assert counts == sorted(counts) and counts[-1] <= exact
    assert counts[-1] >= 0.97 * exact


def test_crossing_pairs_are_split_and_complete(make, monkeypatch):
    graph = random_graph(5, m=120)
    edges, layout = make(*graph)
    edges = edges.distinct()
    want = brute.strip_crossings(graph[0], set(graph[1]), 0.7)[0]
    assert crossing_pairs(layout, edges, 0.7).count() == want
    monkeypatch.setattr(cells, "PAIR_BUDGET", 4)
    found = crossing_pairs(layout, edges, 0.7)
    assert found.count() == found.distinct().count() == want


@pytest.mark.parametrize("budget, r", [(4096, 1.0), (16, 0.3)])
def test_occlusion_of_crowds(make, monkeypatch, budget, r):
    monkeypatch.setattr(cells, "PAIR_BUDGET", budget)
    rng = random.Random(9)
    positions = {f"s{i}": (rng.random() * 20 - 10, rng.random() * 20 - 10) for i in range(60)}
    positions |= {f"c{i}": (3 + rng.random() / 100, 4 + rng.random()) for i in range(60)}
    positions |= {f"e{i}": (1.0, 1.0) for i in range(25)}  # a third of all in few places
    _, layout = make(positions, [("s0", "s1")])
    want = brute.close_pairs(positions, r)
    assert value(node_occlusion_grid(layout, r)) == len(want)
    assert {(p.u, p.v) for p in occluded_pairs(layout, r).collect()} == want
    assert value(node_occlusion(layout, r)) == len(want)
    estimate = value(node_occlusion_hll(layout, r, 0.01))
    assert estimate == pytest.approx(len(want), rel=0.05)


@pytest.mark.parametrize("budget", [16, 2_000])
def test_repulsion(make, monkeypatch, budget):
    """Expansions over many levels and few, with a dense cluster and coincident vertices."""
    monkeypatch.setattr(cells, "PAIR_BUDGET", budget)
    rng = random.Random(2)
    positions = {f"s{i}": (rng.random() * 50, rng.random() * 80) for i in range(100)}
    positions |= {f"c{i}": (7 + rng.random() / 1000, 9 + rng.random() / 1000) for i in range(60)}
    positions |= {f"e{i}": (30.0, 30.0) for i in range(5)}
    _, layout = make(positions, [("s0", "s1")], trials=(0, 1))
    want = brute.repulsion(positions, 3.0)
    got = repulsive_forces(layout, 3.0).collect()
    assert len(got) == 2 * len(positions)
    for row in got:
        assert (row.fx, row.fy) == pytest.approx(want[row.id], rel=1e-9, abs=1e-7)


def test_equal_layouts_in_one_job_measure_equal(make):
    edges, layout = make(*random_graph(6), trials=(0, 1, 7))
    rows = readability_report(layout, edges, r=0.5, g=0.5).collect()
    assert sorted(r.trial for r in rows) == [0, 1, 7]
    assert len({tuple(r)[1:3] for r in rows}) == 1
    for name in ("edge_crossing_angle", "minimum_angle", "edge_length_variation"):
        values = [r[name] for r in rows]
        assert values == pytest.approx([values[0]] * 3)


def test_invariances(make):
    positions, edges = random_graph(8)
    moved = {k: (x + 4.0, y - 7.0) for k, (x, y) in positions.items()}
    larger = {k: (4 * x, 4 * y) for k, (x, y) in positions.items()}
    e, layout = make(positions, edges)
    reversed_edges, _ = make(positions, [(d, s) for s, d in edges])
    _, moved = make(moved, edges)
    _, larger = make(larger, edges)
    ma, elv = value(minimum_angle(layout, e)), value(edge_length_variation(layout, e))
    ec = value(edge_crossing_exact(layout, e))
    for other, links in ((moved, e), (larger, e), (layout, reversed_edges)):
        assert value(minimum_angle(other, links)) == pytest.approx(ma)
        assert value(edge_length_variation(other, links)) == pytest.approx(elv)
        assert value(edge_crossing_exact(other, links)) == ec
    assert value(node_occlusion_grid(moved, 0.5)) == value(node_occlusion_grid(layout, 0.5))


def test_by_strip_covers_strips_without_crossings(make):
    edges, layout = make({"a": (0, 0), "b": (3, 0)}, [("a", "b")])
    rows = edge_crossing_by_strip(layout, edges, 1.0).collect()
    assert sorted((r.part, r.crossings) for r in rows) == [(0, 0), (1, 0), (2, 0)]
