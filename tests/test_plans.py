"""What the physical plans must and must not contain."""

import pytest

from lucidgraph.operators import occlusion
from lucidgraph.operators.angles import minimum_angle, vertex_angles
from lucidgraph.operators.crossing import (
    crossing_pairs,
    edge_crossing_angle,
    edge_crossing_by_strip,
    edge_crossing_strips,
)
from lucidgraph.operators.exact_crossing import edge_crossing_exact
from lucidgraph.operators.layout import layout_step, random_layout, repulsive_forces
from lucidgraph.operators.lengths import edge_length_variation
from lucidgraph.operators.messages import dangling_edges, locate_edges
from lucidgraph.operators.occlusion import node_occlusion_grid
from lucidgraph.operators.raster import layout_raster
from lucidgraph.operators.report import readability_report
from lucidgraph.operators.search import random_baseline
from lucidgraph.sources import samples, vertices_of

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark):
    edges = samples.trade_edges(spark, FOLDER)
    return edges, random_layout(vertices_of(edges), 100.0)


OPERATORS = {
    "occluded_pairs": lambda l, e: occlusion.occluded_pairs(l, 1.0),
    "node_occlusion": lambda l, e: occlusion.node_occlusion(l, 1.0),
    "node_occlusion_cellsum": lambda l, e: occlusion.node_occlusion_cellsum(l, 1.0),
    "node_occlusion_hll": lambda l, e: occlusion.node_occlusion_hll(l, 1.0),
    "node_occlusion_approx": lambda l, e: occlusion.node_occlusion_approx(l, 1.0),
    "by_strip": lambda l, e: edge_crossing_by_strip(l, e, 1.0),
    "bitwise": lambda l, e: edge_crossing_by_strip(l, e, 1.0, plan="bitwise"),
    "strips": lambda l, e: edge_crossing_strips(l, e, 1.0),
    "angle": lambda l, e: edge_crossing_angle(l, e),
    "crossing_pairs": lambda l, e: crossing_pairs(l, e, 5.0),
    "exact": lambda l, e: edge_crossing_exact(l, e),
    "vertex_angles": lambda l, e: vertex_angles(l, e),
    "minimum_angle": lambda l, e: minimum_angle(l, e),
    "lengths": lambda l, e: edge_length_variation(l, e),
    "raster": lambda l, e: layout_raster(l, e),
    "report": lambda l, e: readability_report(l, e, g=1.0),
    "locate_edges": lambda l, e: locate_edges(e, l),
    "dangling": lambda l, e: dangling_edges(e, l, ["trial"]),
    "repulsive_forces": lambda l, e: repulsive_forces(l, 1.0),
    "layout_step": lambda l, e: layout_step(l, e, 1.0, 1.0),
    "baseline": lambda l, e: random_baseline(l.select("id"), e, g=1.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_join_has_keys(graph, name):
    edges, layout = graph
    plan = plan_of(OPERATORS[name](layout, edges))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(samples.trade_edges(spark, FOLDER))
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert sorted(schemas) == [
        "struct<l_orderkey:bigint,l_suppkey:bigint>",
        "struct<o_orderkey:bigint,o_custkey:bigint>",
    ]


def test_bounded_work_stays_in_the_jvm(graph):
    edges, layout = graph
    for operator in (
        lambda: node_occlusion_grid(layout, 1.0),
        lambda: vertex_angles(layout, edges),
        lambda: edge_crossing_by_strip(layout, edges, 1.0, plan="bitwise"),
    ):
        plan = plan_of(operator())
        assert "InArrow" not in plan and "Python" not in plan
