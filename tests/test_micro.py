"""Graphs small enough to work out by hand (FIXTURES.md, section 2)."""

import pytest

from lucidgraph.operators.angles import minimum_angle, vertex_angles
from lucidgraph.operators.crossing import edge_crossing_angle, edge_crossing_strips
from lucidgraph.operators.exact_crossing import edge_crossing_exact
from lucidgraph.operators.layout import layout_step, repulsive_forces
from lucidgraph.operators.lengths import edge_length_variation
from lucidgraph.operators.occlusion import node_occlusion, node_occlusion_grid

from .conftest import value

X = ({"a": (0, 0), "b": (2, 2), "c": (0, 2), "d": (2, 0)}, [("a", "b"), ("c", "d")])
X_NEGATIVE = ({"a": (-2, -2), "b": (0, 0), "c": (-2, 0), "d": (0, -2)}, [("a", "b"), ("c", "d")])
STAR = ({"o": (0, 0), "p": (1, 0), "q": (0, 1)}, [("o", "p"), ("o", "q")])
PATH = ({"a": (0, 0), "b": (1, 0), "c": (4, 0)}, [("a", "b"), ("b", "c")])


def test_x(make):
    edges, layout = make(*X)
    assert [value(edge_crossing_strips(layout, edges, g)) for g in (0.8, 2, 1)] == [1, 1, 0]
    assert value(edge_crossing_exact(layout, edges)) == 1
    assert value(edge_crossing_exact(layout, edges, proper=True)) == 1
    assert value(edge_crossing_angle(layout, edges, g=0.8)) == pytest.approx(0.285714, abs=1e-6)
    for count in (node_occlusion, node_occlusion_grid):
        assert value(count(layout, 1.0)) == 0
        assert value(count(layout, 1.01)) == 4
    assert value(minimum_angle(layout, edges)) == pytest.approx(1.0)
    assert value(edge_length_variation(layout, edges)) == pytest.approx(0.0)


def test_negative_coordinates(make):
    edges, layout = make(*X_NEGATIVE)
    assert [value(edge_crossing_strips(layout, edges, g)) for g in (0.8, 2)] == [1, 1]


def test_star(make):
    edges, layout = make(*STAR)
    assert value(minimum_angle(layout, edges)) == pytest.approx(0.833333, abs=1e-6)
    assert [value(node_occlusion_grid(layout, r)) for r in (0.5, 0.6)] == [0, 2]
    assert value(edge_length_variation(layout, edges)) == pytest.approx(0.0)
    assert value(edge_crossing_exact(layout, edges, proper=True)) == 0
    assert value(edge_crossing_exact(layout, edges)) == 1


def test_path(make):
    edges, layout = make(*PATH)
    assert value(edge_length_variation(layout, edges)) == pytest.approx(0.5)
    assert value(minimum_angle(layout, edges)) == pytest.approx(1.0)
    assert value(node_occlusion(layout, 0.6)) == 1
    assert value(edge_crossing_strips(layout, edges, 0.5)) == 0


@pytest.mark.parametrize("t, x", [(100.0, (0.414214, 0.585786)), (0.1, (0.1, 0.9))])
def test_one_step_of_a_pair(make, t, x):
    edges, layout = make({"u": (0, 0), "v": (1, 0)}, [("u", "v")])
    moved = {r.id: (r.x, r.y) for r in layout_step(layout, edges, 0.5**0.5, t).collect()}
    assert moved["u"] == pytest.approx((x[0], 0), abs=1e-6)
    assert moved["v"] == pytest.approx((x[1], 0), abs=1e-6)


def test_coincident_vertices_stay(make):
    edges, layout = make({"a": (5, 5), "b": (5, 5)}, [])
    assert {(r.x, r.y) for r in layout_step(layout, edges, 1.0, 1.0).collect()} == {(5.0, 5.0)}
    positions = {"a": (0, 0), "b": (0, 0), "c": (3, 0), "d": (4, 0)}
    edges, layout = make(positions, [("c", "d")])
    forces = {r.id: r.fx for r in repulsive_forces(layout, 1.0).collect()}
    # both feel c and d and not each other
    assert forces["a"] == forces["b"] == pytest.approx(-2 / 3 - 2 / 4)


def test_short_edges_count_zero_not_null(make):
    edges, layout = make({"a": (0.1, 0), "b": (0.2, 1), "c": (0.3, 0)}, [("a", "b"), ("b", "c")])
    assert value(edge_crossing_strips(layout, edges, 1.0)) == 0
    assert value(edge_crossing_angle(layout, edges)) is None


def test_single_edge_and_dangling_edge(make):
    edges, layout = make({"a": (0, 0), "b": (1, 1)}, [("a", "b"), ("a", "gone")])
    assert value(edge_length_variation(layout, edges)) is None
    assert {r.id: r.degree for r in vertex_angles(layout, edges).collect()} == {"a": 1, "b": 1}
