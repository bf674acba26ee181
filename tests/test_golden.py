"""Values of FIXTURES.md, section 3, on the small test graph."""

import pytest
from pyspark.sql import functions as F

from lucidgraph.operators.angles import minimum_angle
from lucidgraph.operators.crossing import edge_crossing_angle, edge_crossing_strips
from lucidgraph.operators.exact_crossing import edge_crossing_exact
from lucidgraph.operators.layout import random_layout
from lucidgraph.operators.lengths import edge_length_variation
from lucidgraph.operators.occlusion import disc_cells, node_occlusion_cellsum, node_occlusion_grid
from lucidgraph.operators.strips import strip_segments
from lucidgraph.session import materialize
from lucidgraph.sources import edges_from_table, vertices_of

from .conftest import DATA, value

GOLDEN = {
    "0.001": dict(
        edges=91, vertices=65, nc=1, discs=250, cellsum=2, segments=3713, ec5=671, ec1=866,
        ec01=910, proper=915, meeting=1364, eca=0.287147, ma=0.540116, elv=0.05018005,
    ),
    "0.01": dict(
        edges=823, vertices=603, nc=196, discs=2294, cellsum=447, segments=27021, ec5=46679,
        ec1=63570, ec01=70354, proper=71141, meeting=74994, eca=0.291536, ma=0.603837,
        elv=0.0168905,
    ),
}


@pytest.mark.parametrize("sf", GOLDEN)
def test_golden(spark, sf):
    want = GOLDEN[sf]
    lines = spark.read.parquet(f"{DATA}/sf{sf}/lineitem.parquet").where("l_linenumber = 1")
    orders = spark.read.parquet(f"{DATA}/sf{sf}/orders.parquet").where("o_orderkey % 10 = 0")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = materialize(
        edges_from_table(
            joined,
            F.concat(F.lit("c"), F.col("o_custkey")),
            F.concat(F.lit("s"), F.col("l_suppkey")),
        )
    )
    layout = materialize(random_layout(vertices_of(edges), 100.0))
    assert edges.count() == want["edges"] and layout.count() == want["vertices"]
    assert value(node_occlusion_grid(layout, 0.01)) == 0
    assert value(node_occlusion_grid(layout, 1.0)) == want["nc"]
    assert disc_cells(layout, 1.0).count() == want["discs"]
    assert value(node_occlusion_cellsum(layout, 1.0)) == want["cellsum"]
    assert strip_segments(layout, edges, 1.0).count() == want["segments"]
    for name, g in (("ec5", 5.0), ("ec1", 1.0), ("ec01", 0.1)):
        assert value(edge_crossing_strips(layout, edges, g)) == want[name]
    assert value(edge_crossing_exact(layout, edges, proper=True)) == want["proper"]
    assert value(edge_crossing_exact(layout, edges)) == want["meeting"]
    assert value(edge_crossing_angle(layout, edges)) == pytest.approx(want["eca"], abs=1e-6)
    assert value(minimum_angle(layout, edges)) == pytest.approx(want["ma"], abs=1e-6)
    assert value(edge_length_variation(layout, edges)) == pytest.approx(want["elv"], abs=1e-7)
