"""

Every query reads whole tables.  Three graphs are taken from them:

* ``trade``      customer - supplier, dense and bipartite;
* ``purchases``  order - customer, many vertices of low degree;
* ``geography``  customer/supplier - nation - region, a tree with hubs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from pathlib import Path
from statistics import NormalDist

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lucidgraph.operators import angles, crossing, guided, lengths, messages  # noqa: E402
from lucidgraph.operators import exact_crossing as exact  # noqa: E402
from lucidgraph.operators import layout as layouts  # noqa: E402
from lucidgraph.operators import occlusion, progress, raster, report, search, strips  # noqa: E402
from lucidgraph.session import materialize, scratch_path, stored  # noqa: E402
from lucidgraph.sources import (  # noqa: E402
    read_edge_list,
    read_layout,
    read_trials,
    vertices_of,
    write_layout,
    write_trials,
)
from lucidgraph.sources import samples  # noqa: E402
from lucidgraph.streaming import stream_trials  # noqa: E402

try:
    from lucidgraph.llm import queries as _llm
except ImportError:  # the folder, or something that it needs, may be left out
    _llm = None

_GRAPHS = {
    "trade": samples.trade_edges,
    "purchases": samples.purchase_edges,
    "geography": samples.geography_edges,
}
_C, _T, _K = 10.0, 100.0, 3.0
_SHORT = 0.1


def _edges(spark: SparkSession, folder: str, graph: str) -> DataFrame:
    return _GRAPHS[graph](spark, folder)


def _placed(
    spark: SparkSession, folder: str, graph: str, scale: float = 100.0
) -> tuple[DataFrame, DataFrame]:
    """(edges, random layout), written once because the operators read them often."""
    edges = stored(_edges(spark, folder, graph), "edges")
    return edges, stored(layouts.random_layout(vertices_of(edges), scale), "layout")


def _round(df: DataFrame, *names: str) -> DataFrame:
    # + 0.0 turns a negative zero into a positive one
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in names})


def entry(spark: SparkSession) -> DataFrame:
    """How readable is a random layout of the trade graph, by all five metrics?"""
    edges, layout = _placed(spark, "/root/testdata/sf0.001", "trade")
    return report.readability_report(layout, edges, r=1.0, g=0.1)


# --- queries -----------------------------------------------------------------


def _edge_list_text(spark, d):
    path = scratch_path(spark, "edges")
    edges = _edges(spark, d, "trade")
    edges.select(F.concat_ws(" \t", "src", "dst").alias("value")).write.text(path)
    return read_edge_list(spark, path)


def _dangling(spark, d):
    edges = _edges(spark, d, "geography")
    placed = vertices_of(edges).where(~F.col("id").startswith("r"))
    return messages.dangling_edges(edges, layouts.random_layout(placed, 100.0))


def _step(spark, d, steps, t=_T, digits=6):
    edges = materialize(_edges(spark, d, "geography"))
    out = layouts.force_layout(vertices_of(edges), edges, _C, t, iterations=steps)
    return out.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in ("x", "y")})


def _degree_sum(spark, d):
    edges, layout = _placed(spark, d, "trade")
    ends = layout.select("trial", "id", "x")
    return _round(
        messages.aggregate_messages(
            ends,
            edges,
            [F.count("msg").alias("degree"), F.sum("msg").alias("sum_x")],
            to_src=F.col("dst_x"),
            to_dst=F.col("src_x"),
            by=["trial"],
        ),
        "sum_x",
    )


def _region_trials(spark, d):
    regions = spark.read.parquet(f"{d}/region.parquet")
    return search.trial_candidates(regions.select(F.col("r_regionkey").alias("trial")))


def _evaluated(spark, d):
    edges = materialize(_edges(spark, d, "geography"))
    vertices = materialize(vertices_of(edges))
    out = search.evaluate_trials(
        vertices, edges, _region_trials(spark, d), iterations=1, r=1.0, g=5.0
    )
    return _round(out.drop("nc_t", "ec_t"), "c", "t", "score")


def _estimated(layout):
    """The exact count, and whether the sketch is within three of its standard deviations."""
    rsd = 0.02
    none = F.lit(None).cast("bigint")
    exact_ = occlusion.node_occlusion(layout, 0.5).withColumn("estimate", none)
    estimate = occlusion.node_occlusion_hll(layout, 0.5, rsd).select(
        "trial", none.alias("node_occlusion"), F.col("node_occlusion").alias("estimate")
    )
    both = exact_.unionByName(estimate).groupBy("trial").agg(
        F.max("node_occlusion").alias("node_occlusion"), F.max("estimate").alias("estimate")
    )
    error = F.abs(F.col("estimate") - F.col("node_occlusion"))
    return both.select(
        "trial", "node_occlusion", (error <= 3 * rsd * F.col("node_occlusion")).alias("within")
    )


def _within(layout):
    """A count that stops after 40 of 64 parts, with what it says of the rest."""
    found = occlusion.node_occlusion_within(layout, 0.5, timeout_ms=None, at_most=40)
    return found.withColumns(
        {c: F.round(c, 4) + F.lit(0.0) for c in ("node_occlusion", "low", "high")}
    )


def _meeting(spark, d):
    """Each customer's edge to its nation with the edge of the supplier of equal number."""
    edges, layout = _placed(spark, d, "geography")
    number = F.substring("src", 2, 20)
    located = messages.locate_edges(edges, layout).withColumn("number", number)
    a = located.where(F.col("src").startswith("c")).select("number", *_ends("a"))
    b = located.where(F.col("src").startswith("s")).select("number", *_ends("b"))
    return exact.meeting(a.join(b, "number")).select("number", "meet", "cross")


def _ends(name):
    return [F.col(c).alias(f"{name}_{c}") for c in ("x1", "y1", "x2", "y2")]


def _search(spark, d, path=None):
    edges = materialize(_edges(spark, d, "geography"))
    return search.sweep(
        materialize(vertices_of(edges)), edges, rounds=2, per_round=3, keep=2, iterations=1, g=5.0, path=path, guide="near"
    )


def _search_history(spark, d):
    path = scratch_path(spark, "sweep")
    _search(spark, d, path)
    found = read_trials(spark, search.history_path(path))
    return _round(found.drop("nc_t", "ec_t"), "c", "t", "score")


def _search_layout(spark, d):
    path = scratch_path(spark, "sweep")
    _search(spark, d, path)
    return _round(search.best_layout(spark, path), "x", "y")


def _proposed(spark, d):
    """The next trial of every customer's study, whose trials are its orders and the score their price."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    points = search.trial_candidates(orders.select(F.col("o_orderkey").alias("trial")))
    scores = orders.select(
        F.col("o_orderkey").alias("trial"),
        F.col("o_custkey").alias("study"),
        (F.col("o_totalprice") / 1000).alias("score"),
    )
    found = guided.proposed_trials(points.join(scores, "trial"), by=["study"], candidates=64)
    return _round(found.drop("place"), "c", "t").withColumn(
        "expected_improvement", F.round("expected_improvement", 3) + F.lit(0.0)
    )


def _order_history(spark, d):
    """A trial history with one trial per order, scored by its price."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").cast("bigint").alias("trial"),
        F.col("o_custkey").alias("study"),
        F.lit(_C).alias("c"),
        F.lit(_T).alias("t"),
        F.col("o_custkey").alias("nc"),
        F.lit(0.0).alias("nc_t"),
        F.col("o_orderkey").alias("ec"),
        F.lit(0.0).alias("ec_t"),
        F.col("o_totalprice").alias("score"),
    )


def _trials_roundtrip(spark, d):
    path = scratch_path(spark, "trials")
    write_trials(_order_history(spark, d), path)
    return read_trials(spark, path)


def _stream(spark, d):
    path = scratch_path(spark, "trials")
    write_trials(_order_history(spark, d), path)
    name = "status_" + path.rsplit("-", 1)[-1]
    query = (
        stream_trials(spark, path)
        .writeStream.outputMode("complete")
        .format("memory")
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(name)


def _layout_roundtrip(spark, d):
    path = scratch_path(spark, "layout")
    write_layout(layouts.random_layout(vertices_of(_edges(spark, d, "purchases")), 100.0), path)
    return _round(read_layout(spark, path), "x", "y")


def _progress(spark, d):
    """A log per customer: each order starts a trial, its lines are the stages."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    number = F.col("l_linenumber")
    line = (
        F.when(number == 1, F.concat(F.lit("##NewIteration:"), F.col("o_orderkey") % 50, F.lit("##")))
        .when(number == 2, F.concat(F.lit("##LayoutGen##:  "), F.col("l_quantity").cast("int"), F.lit("%|")))
        .when(number == 3, F.lit("##ComputeNodeOcclusion##"))
        .when(number == 4, F.lit("##ComputeEdgeCrossing##"))
        .when(number == 5, F.lit("##Visualizing##"))
        .otherwise(F.lit("node_occlusion took 1 sec"))
    )
    log = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("run"),
        (F.col("l_orderkey") * 10 + number).alias("line_no"),
        line.alias("line"),
    )
    return progress.trial_progress(log, 50, ["run"])


def _on(graph: str, function: Callable, *rounded: str, scale: float = 100.0, edges_first=False):
    """A query that applies an operator to a placed graph."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        edges, layout = _placed(spark, d, graph, scale)
        return _round(function(layout, edges), *rounded)

    return run


def _of_layout(graph: str, function: Callable, *rounded: str, scale: float = 100.0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, layout = _placed(spark, d, graph, scale)
        return _round(function(layout), *rounded)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    return (_llm.QUERIES if _llm else {}) | {
        # sources
        "vertices": lambda s, d: vertices_of(_edges(s, d, "trade")),
        "edges_from_table": lambda s, d: _edges(s, d, "trade"),
        "edge_list_text": _edge_list_text,
        "layout_roundtrip": _layout_roundtrip,
        "trials_roundtrip": _trials_roundtrip,
        # joins and messages
        "edges_xy": _on(
            "purchases", lambda l, e: messages.locate_edges(e, l), "x1", "y1", "x2", "y2"
        ),
        "dangling_edges": _dangling,
        "message_degree_sum": _degree_sum,
        "vertex_pairs_count": lambda s, d: layouts.vertex_pair_count(
            vertices_of(_edges(s, d, "purchases"))
        ),
        # layouts
        "random_layout": _of_layout("purchases", lambda l: l, "x", "y"),
        "repulsive_forces": _of_layout(
            "purchases", lambda l: layouts.repulsive_forces(l, _K), "fx", "fy"
        ),
        "attractive_forces": _on(
            "geography", lambda l, e: layouts.attractive_forces(l, e, _K), "fx", "fy"
        ),
        "net_forces": _on(
            "geography",
            lambda l, e: layouts.net_forces(
                layouts.repulsive_forces(l, _K), layouts.attractive_forces(l, e, _K)
            ),
            "fx",
            "fy",
        ),
        "layout_step1": lambda s, d: _step(s, d, 1),
        "layout_step2": lambda s, d: _step(s, d, 2),
        # steps this short do not amplify the last bit
        "force_layout_10": lambda s, d: _step(s, d, 10, _SHORT, 4),
        # node occlusion
        "node_occlusion_exact": _of_layout("purchases", lambda l: occlusion.node_occlusion(l, 1.0)),
        "node_occlusion_grid": _of_layout(
            "purchases", lambda l: occlusion.node_occlusion_grid(l, 1.0)
        ),
        "node_occlusion_dense": _of_layout(
            "purchases", lambda l: occlusion.node_occlusion_grid(l, 0.2), scale=1.0
        ),
        "occluded_pairs": _of_layout("purchases", lambda l: occlusion.occluded_pairs(l, 0.25)),
        "disc_cells": _of_layout(
            "purchases", lambda l: occlusion.disc_cells(l, 1.0), "x", "y"
        ),
        "node_occlusion_cellsum": _of_layout(
            "purchases", lambda l: occlusion.node_occlusion_cellsum(l, 1.0)
        ),
        "node_occlusion_sampled": _of_layout(
            "purchases", lambda l: occlusion.node_occlusion_approx(l, 1.0, 0.5, 7)
        ),
        "node_occlusion_hll": _of_layout("purchases", _estimated),
        "node_occlusion_within": _of_layout("purchases", _within),
        # edge crossing
        "strip_segments": _on(
            "geography", lambda l, e: strips.strip_segments(l, e, 1.0), "ly", "ry", "theta"
        ),
        "strip_histogram": _on("trade", lambda l, e: strips.strip_histogram(l, e, 1.0)),
        "edge_crossing_by_strip": _on(
            "trade", lambda l, e: crossing.edge_crossing_by_strip(l, e, 1.0)
        ),
        "edge_crossing_strips": _on(
            "trade", lambda l, e: crossing.edge_crossing_strips(l, e, 1.0)
        ),
        "edge_crossing_strips_bitwise": _on(
            "geography", lambda l, e: crossing.edge_crossing_strips(l, e, 1.0, plan="bitwise")
        ),
        "edge_crossing_strips_chunked": _on(
            "geography",
            lambda l, e: crossing.edge_crossing_strips(l, e, 1.0, max_rows=64, chunk_rows=4096),
        ),
        "edge_crossing_exact": _on("geography", lambda l, e: exact.edge_crossing_exact(l, e)),
        "edge_crossing_proper": _on(
            "geography", lambda l, e: exact.edge_crossing_exact(l, e, proper=True)
        ),
        "edge_crossing_proper_trade": _on(
            "trade", lambda l, e: exact.edge_crossing_exact(l, e, proper=True)
        ),
        "crossing_pairs": _on(
            "geography", lambda l, e: crossing.crossing_pairs(l, e, 1.0), "theta"
        ),
        "edge_crossing_angle": _on(
            "geography", lambda l, e: crossing.edge_crossing_angle(l, e), "edge_crossing_angle"
        ),
        "edge_crossing_angle_trade": _on(
            "trade", lambda l, e: crossing.edge_crossing_angle(l, e), "edge_crossing_angle"
        ),
        "edge_crossing_angle_purchases": _on(
            "purchases", lambda l, e: crossing.edge_crossing_angle(l, e, g=10.0), "edge_crossing_angle"
        ),
        "edge_crossing_angle_chunked": _on(
            "geography",
            lambda l, e: crossing.edge_crossing_angle(l, e, max_rows=64, chunk_rows=4096),
            "edge_crossing_angle",
        ),
        "segments_meeting": _meeting,
        # angles and lengths
        "vertex_angles": _on(
            "trade", lambda l, e: angles.vertex_angles(l, e), "min_gap", "deviation"
        ),
        "minimum_angle": _on(
            "trade", lambda l, e: angles.minimum_angle(l, e), "minimum_angle"
        ),
        "edge_lengths": _on("purchases", lambda l, e: lengths.edge_lengths(l, e), "length"),
        "edge_length_variation": _on(
            "trade", lambda l, e: lengths.edge_length_variation(l, e), "edge_length_variation"
        ),
        "readability_report": _on(
            "geography",
            lambda l, e: report.readability_report(l, e, r=1.0, g=1.0),
            "edge_crossing_angle",
            "minimum_angle",
            "edge_length_variation",
        ),
        "layout_raster": _on("geography", lambda l, e: raster.layout_raster(l, e, 64, 64)),
        # search
        "random_baseline": lambda s, d: search.random_baseline(
            vertices_of(_edges(s, d, "geography")), _edges(s, d, "geography")
        ),
        "trial_candidates": lambda s, d: _round(
            search.trial_candidates(
                s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("trial"))
            ),
            "c",
            "t",
        ),
        "evaluate_trials_step1": _evaluated,
        "list_trials": lambda s, d: search.list_trials(_order_history(s, d)),
        "best_trial": lambda s, d: search.best_trial(_order_history(s, d)),
        "best_trial_by_study": lambda s, d: search.best_trial(_order_history(s, d), ["study"]),
        "sweep": lambda s, d: _round(_search(s, d).drop("nc_t", "ec_t"), "c", "t", "score"),
        "sweep_history": _search_history,
        "sweep_best_layout": _search_layout,
        "proposed_trials": _proposed,
        "trial_progress": _progress,
        "stream_trials": _stream,
    }


# --- the same in DuckDB SQL --------------------------------------------------

_EDGE_SQL = {
    "trade": """SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL""",
    "purchases": """SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst
        FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL""",
    "geography": """SELECT DISTINCT * FROM (
        SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
        WHERE src IS NOT NULL AND dst IS NOT NULL""",
}


def _hash_sql(name: str, seed: int) -> str:
    return f"(('0x' || substr(md5({name} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _placed_sql(graph: str, scale: float = 100.0) -> str:
    """CTEs edges, vertices, layout, located and lines of a graph."""
    return f"""WITH edges AS MATERIALIZED ({_EDGE_SQL[graph]}),
    vertices AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
    layout AS MATERIALIZED (SELECT 0 AS trial, id, {_hash_sql('id', 42)} * {scale}::DOUBLE AS x,
        {_hash_sql('id', 41)} * {scale}::DOUBLE AS y FROM vertices),
    {_located_sql('layout')}"""


def _located_sql(layout: str) -> str:
    return f"""located AS MATERIALIZED (SELECT a.trial, src, dst,
        a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM edges JOIN {layout} a ON a.id = src JOIN {layout} b ON b.id = dst AND b.trial = a.trial),
    lines AS MATERIALIZED (SELECT trial, src, dst, row_number() OVER (ORDER BY trial, src, dst) AS n,
        CASE WHEN (x1, y1) <= (x2, y2) THEN x1 ELSE x2 END AS xl,
        CASE WHEN (x1, y1) <= (x2, y2) THEN y1 ELSE y2 END AS yl,
        CASE WHEN (x1, y1) <= (x2, y2) THEN x2 ELSE x1 END AS xr,
        CASE WHEN (x1, y1) <= (x2, y2) THEN y2 ELSE y1 END AS yr FROM located)"""


def _segments_sql(g: float, name: str = "segments") -> str:
    size = f"{g}::DOUBLE"

    def height(x: str) -> str:
        return f"CASE WHEN {x} = xr THEN yr ELSE yl + (yr - yl) * ({x} - xl) / (xr - xl) END"

    return f""", {name} AS MATERIALIZED (SELECT trial, src, dst, part,
        {height(f'(part * {size})')} AS ly, {height(f'((part + 1) * {size})')} AS ry,
        atan2(yr - yl, xr - xl) AS theta
        FROM (SELECT *, unnest(range(ceil(xl / {size})::BIGINT, floor(xr / {size})::BIGINT)) AS part
              FROM lines WHERE xl < xr))"""


def _inversions_sql() -> str:
    """Crossings per strip from ranks and one window per bit: no pairs."""
    return """, ranked AS MATERIALIZED (SELECT trial, part,
        row_number() OVER (PARTITION BY trial, part ORDER BY ly, ry) AS lr,
        row_number() OVER (PARTITION BY trial, part ORDER BY ry, ly) - 1 AS rr FROM segments),
    bits AS (SELECT unnest(range(0, (SELECT length(bin(max(rr))) FROM ranked))) AS b),
    seen AS (SELECT trial, part, (rr >> b) & 1 AS high,
        sum((rr >> b) & 1) OVER (PARTITION BY trial, part, b, rr >> (b + 1) ORDER BY lr
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ones
        FROM ranked CROSS JOIN bits),
    per_strip AS (SELECT trial, part,
        sum(CASE WHEN high = 0 THEN coalesce(ones, 0) ELSE 0 END)::BIGINT AS crossings
        FROM seen GROUP BY trial, part)"""


_CROSSING_ON = "a.trial = b.trial AND a.part = b.part AND a.ly < b.ly AND a.ry > b.ry"
_DELTA = "abs(a.theta - b.theta)"
_ACUTE = f"least({_DELTA}, pi() - {_DELTA})"
_CLOSE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < ({r}::DOUBLE * 2) * ({r}::DOUBLE * 2)"


def _meets_sql(proper: bool) -> str:
    def side(p: str, q: str, r: str) -> str:
        (px, py), (qx, qy), (rx, ry) = p.split(), q.split(), r.split()
        return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"

    a, b, c, d = "a.xl a.yl", "a.xr a.yr", "b.xl b.yl", "b.xr b.yr"
    s1 = f"({side(a, b, c)} * {side(a, b, d)})"
    s2 = f"({side(c, d, a)} * {side(c, d, b)})"
    if proper:
        return f"{s1} < 0 AND {s2} < 0"
    overlap = "(b.xl, b.yl) <= (a.xr, a.yr) AND (a.xl, a.yl) <= (b.xr, b.yr)"
    return f"CASE WHEN {s1} = 0 AND {s2} = 0 THEN {overlap} ELSE {s1} <= 0 AND {s2} <= 0 END"


def _exact_sql(graph: str, proper: bool) -> str:
    # the boxes of two edges that meet overlap
    return f"""{_placed_sql(graph)}
    SELECT 0 AS trial, count(*) AS edge_crossing FROM lines a JOIN lines b
    ON a.n < b.n AND a.xl <= b.xr AND b.xl <= a.xr
    AND least(a.yl, a.yr) <= greatest(b.yl, b.yr) AND least(b.yl, b.yr) <= greatest(a.yl, a.yr)
    WHERE {_meets_sql(proper)}"""


def _repulsion_sql(layout: str, k: str) -> str:
    d2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"""SELECT a.trial, a.id, sum(2 * {k} * {k} * (a.x - b.x) / {d2}) AS fx,
        sum(2 * {k} * {k} * (a.y - b.y) / {d2}) AS fy
        FROM {layout} a JOIN {layout} b ON a.trial = b.trial AND a.id <> b.id
        AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.trial, a.id"""


def _attraction_sql(layout: str, k: str) -> str:
    d = "sqrt((o.x - v.x) * (o.x - v.x) + (o.y - v.y) * (o.y - v.y))"
    return f"""SELECT v.trial, v.id, sum((o.x - v.x) * {d} / {k}) AS fx, sum((o.y - v.y) * {d} / {k}) AS fy
        FROM (SELECT src AS v, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges) m
        JOIN {layout} v ON v.id = m.v JOIN {layout} o ON o.id = m.o AND o.trial = v.trial
        GROUP BY v.trial, v.id"""


def _forces_sql(layout: str, k: str) -> str:
    return f"""SELECT trial, id, sum(fx) AS fx, sum(fy) AS fy FROM (
        {_repulsion_sql(layout, k)} UNION ALL {_attraction_sql(layout, k)}) GROUP BY trial, id"""


def _step_sql(number: int, layout: str, k: str, t: str) -> str:
    return f""", forces{number} AS MATERIALIZED ({_forces_sql(layout, k)}),
    step{number} AS MATERIALIZED (SELECT l.* REPLACE (
        l.x + coalesce(f.fx / norm * least(norm, {t}), 0) AS x,
        l.y + coalesce(f.fy / norm * least(norm, {t}), 0) AS y)
        FROM {layout} l LEFT JOIN (SELECT *, nullif(sqrt(fx * fx + fy * fy), 0) AS norm
        FROM forces{number}) f USING (trial, id))"""


def _layout_sql(steps: int, t: float = _T, digits: int = 6) -> str:
    k = f"({_C}::DOUBLE * sqrt(10000.0::DOUBLE / (SELECT count(*) FROM vertices)))"
    sql, layout = _placed_sql("geography", 1.0), "layout"
    for number in range(1, steps + 1):
        sql += _step_sql(number, layout, k, f"{t}::DOUBLE")
        layout = f"step{number}"
    return (
        f"{sql} SELECT trial, id, round(x, {digits}) + 0.0 AS x, round(y, {digits}) + 0.0 AS y FROM {layout}"
    )


_DISC_SQL = """, homes AS (SELECT *, floor(x / 2.0::DOUBLE)::BIGINT AS hx, floor(y / 2.0::DOUBLE)::BIGINT AS hy
        FROM layout),
    discs AS MATERIALIZED (SELECT trial, id, x, y, hx + sx AS cell_x, hy + sy AS cell_y FROM homes
        CROSS JOIN (VALUES (-1), (0), (1)) AS t1(sx) CROSS JOIN (VALUES (-1), (0), (1)) AS t2(sy)
        WHERE CASE
            WHEN sx = 0 AND sy = 0 THEN true
            WHEN sy = 0 THEN floor((x + sx * 1.0::DOUBLE) / 2.0::DOUBLE)::BIGINT <> hx
            WHEN sx = 0 THEN floor((y + sy * 1.0::DOUBLE) / 2.0::DOUBLE)::BIGINT <> hy
            ELSE ((hx + greatest(sx, 0)) * 2.0::DOUBLE - x) * ((hx + greatest(sx, 0)) * 2.0::DOUBLE - x)
               + ((hy + greatest(sy, 0)) * 2.0::DOUBLE - y) * ((hy + greatest(sy, 0)) * 2.0::DOUBLE - y)
               <= 1.0::DOUBLE END)"""

_DIRECTIONS_SQL = """, directions AS (SELECT trial, src AS id, atan2(y2 - y1, x2 - x1) AS a FROM located
        UNION ALL SELECT trial, dst, atan2(y1 - y2, x1 - x2) FROM located),
    folded AS (SELECT trial, id, CASE WHEN a >= 0 THEN a ELSE a + 2 * pi() END AS a FROM directions),
    gaps AS (SELECT trial, id, a, a - lag(a) OVER (PARTITION BY trial, id ORDER BY a) AS gap FROM folded),
    vertex_gaps AS (SELECT trial, id, count(*) AS degree,
        least(min(gap), 2 * pi() - (max(a) - min(a))) AS min_gap FROM gaps GROUP BY trial, id),
    deviations AS (SELECT *, (2 * pi() / degree - min_gap) / (2 * pi() / degree) AS deviation
        FROM vertex_gaps)"""

_LENGTH = "sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))"

_ORDER_HISTORY_SQL = f"""SELECT o_orderkey AS trial, {_C}::DOUBLE AS c, {_T}::DOUBLE AS t,
    o_custkey AS nc, 0.0::DOUBLE AS nc_t, o_orderkey AS ec, 0.0::DOUBLE AS ec_t, o_totalprice AS score"""


def _occlusion_sql(graph: str, r: float, scale: float = 100.0) -> str:
    return f"""{_placed_sql(graph, scale)} SELECT 0 AS trial, count(*) AS node_occlusion
        FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=r)}"""


def _evaluate_sql() -> str:
    c = f"(1.0::DOUBLE + {_hash_sql('r_regionkey', 42)} * 19.0::DOUBLE)"
    t = f"(0.1::DOUBLE + {_hash_sql('r_regionkey', 43)} * 99.9::DOUBLE)"
    trials = f"SELECT r_regionkey::BIGINT AS trial, {c} AS c, {t} AS t FROM region"
    return f"{_baseline_sql()}{_trials_sql(1, trials)} {_SCORED.format(n=1)}"


def _baseline_sql() -> str:
    return f"""{_placed_sql("geography")}{_segments_sql(5.0, "base_segments")}, base AS MATERIALIZED (SELECT
        (SELECT count(*) FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=1.0)}) AS nc0,
        (SELECT count(*) FROM base_segments a JOIN base_segments b ON {_CROSSING_ON}) AS ec0)"""


def _trials_sql(n: int, trials: str) -> str:
    """CTEs trials<n>, step<n> (layouts after one step) and scored<n>."""
    aim = "sqrt(10000.0::DOUBLE / (SELECT count(*) FROM vertices))"
    start = f""", trials{n} AS MATERIALIZED ({trials}),
    start{n} AS MATERIALIZED (SELECT trial, id, {_hash_sql('id', 42)} AS x, {_hash_sql('id', 41)} AS y,
        c * {aim} AS k, t FROM vertices CROSS JOIN trials{n})"""
    # k and t are columns of the layout here
    step = _step_sql(n, f"start{n}", "max(a.k)", "l.t")
    step = step.replace("2 * max(a.k) * max(a.k) * ", "2 * a.k * a.k * ").replace("max(a.k)", "v.k")
    located = _located_sql(f"step{n}").replace("located AS", f"located{n} AS")
    located = located.replace("lines AS", f"lines{n} AS").replace("FROM located)", f"FROM located{n})")
    segments = _segments_sql(5.0, f"segments{n}").replace("FROM lines", f"FROM lines{n}")
    return f"""{start}{step}, {located}{segments},
    nc{n} AS (SELECT a.trial, count(*) AS nc FROM step{n} a JOIN step{n} b
        ON a.trial = b.trial AND a.id < b.id AND {_CLOSE.format(r=1.0)} GROUP BY a.trial),
    ec{n} AS (SELECT a.trial, count(*) AS ec FROM segments{n} a JOIN segments{n} b ON {_CROSSING_ON}
        GROUP BY a.trial),
    scored{n} AS MATERIALIZED (SELECT trial, c, t, coalesce(nc, 0) AS nc, coalesce(ec, 0) AS ec,
        coalesce(nc, 0) / nullif(nc0, 0)::DOUBLE + coalesce(ec, 0) / nullif(ec0, 0)::DOUBLE AS score
        FROM trials{n} LEFT JOIN nc{n} USING (trial) LEFT JOIN ec{n} USING (trial) CROSS JOIN base)"""


_SCORED = """SELECT trial, round(c, 6) AS c, round(t, 6) AS t, nc, ec, round(score, 6) AS score FROM scored{n}"""


def _sweep_sql() -> str:
    """Two rounds of three trials, the second around the best two of the first."""
    ranges = (("c", 1.0, 20.0, 42), ("t", 0.1, 100.0, 43))
    first = ", ".join(
        f"{low}::DOUBLE + {_hash_sql('trial', seed)} * {high - low}::DOUBLE AS {name}"
        for name, low, high, seed in ranges
    )
    near = ", ".join(
        f"least(greatest({name} + ({_hash_sql('i', seed)} - 0.5::DOUBLE) * {high - low}::DOUBLE,"
        f" {low}::DOUBLE), {high}::DOUBLE) AS {name}"
        for name, low, high, seed in ranges
    )
    one = _trials_sql(1, f"SELECT trial, {first} FROM range(0, 3) AS r(trial)")
    best = """, best AS MATERIALIZED (SELECT c, t,
        row_number() OVER (ORDER BY score NULLS LAST, trial) - 1 AS place FROM scored1)"""
    two = _trials_sql(2, f"SELECT i AS trial, {near} FROM range(3, 6) AS r(i) JOIN best ON place = i % 2")
    return f"""{_baseline_sql()}{one}{best}{two},
    scored AS (SELECT * FROM scored1 UNION ALL SELECT * FROM scored2)"""


def _odd_products(count: int) -> list[float]:
    """1, 1 * 3, 1 * 3 * 5 and so on."""
    out = [1.0]
    for i in range(1, count):
        out.append(out[-1] * (2 * i + 1))
    return out


def _proposed_sql() -> str:
    """The model by Gauss-Jordan elimination on [covariances | values | candidates' covariances].

    Per study and length scale each trial is a row; after the last step the columns are
    the covariances' inverse times what stood there.
    """
    lengths = ", ".join(f"({x}::DOUBLE)" for x in guided.LENGTHS)
    scaled = ", ".join(
        f"((({low}::DOUBLE + {_hash_sql('o_orderkey', seed)} * {high - low}::DOUBLE) - {low}::DOUBLE)"
        f" / {high - low}::DOUBLE) AS {name}"
        for name, low, high, seed in (("u", 1.0, 20.0, 42), ("v", 0.1, 100.0, 43))
    )
    near = ", ".join(
        f"least(greatest(b.{c} + (s.{c} - 0.5::DOUBLE) * {2 * guided.LOCAL_RADIUS}::DOUBLE, 0), 1) AS {c}"
        for c in "uv"
    )

    def matern(a: str, b: str) -> str:
        d = f"(sqrt(({a}.u - {b}.u) ** 2 + ({a}.v - {b}.v) ** 2) * sqrt(5.0::DOUBLE) / length)"
        return f"((1 + {d} + {d} * {d} / 3) * exp(-{d}))"

    z = "((best - mean) / deviation)"
    density = f"(exp(-0.5 * {z} * {z}) / sqrt(2 * pi()))"
    # Phi(z) = 1/2 + density * (z + z^3/3 + z^5/15 + ...)
    series = f"list_sum(list_transform(range(0, 70), lambda n: {z} ** (2 * n + 1) / ({_odd_products(70)}::DOUBLE[])[n + 1]))"
    return f"""WITH RECURSIVE trials AS MATERIALIZED (SELECT o_custkey AS study, {scaled},
        o_totalprice / 1000 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    studies AS (SELECT study, count(*) AS n, avg(score) AS middle,
        CASE WHEN stddev_pop(score) > 0 THEN stddev_pop(score) ELSE 1 END AS spread,
        arg_min(u, (score, i)) AS u, arg_min(v, (score, i)) AS v, min(score) AS least FROM trials GROUP BY study),
    observed AS MATERIALIZED (SELECT study, t.u, t.v, i, n, (score - middle) / spread AS y FROM trials t JOIN studies USING (study)),
    square AS (SELECT n AS k, {_hash_sql('n', 42)} AS u, {_hash_sql('n', 43)} AS v FROM range(0, 64) AS r(n)),
    points AS MATERIALIZED (SELECT study, k, s.u, s.v FROM studies CROSS JOIN square s
        UNION ALL SELECT study, 64 + k, {near} FROM studies b CROSS JOIN square s WHERE k < 16),
    lengths(length) AS (VALUES {lengths}),
    own AS (SELECT a.study, length, a.i, list({matern('a', 'b')} + CASE WHEN a.i = b.i THEN {guided.NOISE} ELSE 0 END ORDER BY b.i)
        || [any_value(a.y)] AS row FROM observed a JOIN observed b USING (study) CROSS JOIN lengths GROUP BY a.study, length, a.i),
    cross_ AS MATERIALIZED (SELECT a.study, length, i, list({matern('a', 'p')} ORDER BY k) AS row
        FROM observed a JOIN points p USING (study) CROSS JOIN lengths GROUP BY a.study, length, i),
    step AS (SELECT study, length, i, 1 AS k, n, own.row || cross_.row AS row, 0::DOUBLE AS log_pivots
        FROM own JOIN cross_ USING (study, length, i) JOIN studies USING (study)
        UNION ALL SELECT a.study, a.length, a.i, a.k + 1, a.n,
            CASE WHEN a.i = p.i THEN list_transform(a.row, lambda x: x / p.row[p.i])
            ELSE list_transform(list_zip(a.row, p.row), lambda x: x[1] - x[2] * (a.row[p.i] / p.row[p.i])) END,
            a.log_pivots + ln(p.row[p.i])
        FROM step a JOIN step p ON a.study = p.study AND a.length = p.length AND a.k = p.k AND p.i = a.k
        WHERE a.k <= a.n),
    solved AS MATERIALIZED (SELECT * FROM step WHERE k = n + 1),
    chosen AS (SELECT study, arg_max(length, (-0.5 * fit - 0.5 * log_pivots, -length)) AS length
        FROM (SELECT s.study, length, sum(y * row[s.n + 1]) AS fit, any_value(log_pivots) AS log_pivots
        FROM solved s JOIN observed o ON o.study = s.study AND o.i = s.i GROUP BY s.study, length) GROUP BY study),
    predicted AS (SELECT s.study, k, sum(kept * row[n + 1]) AS mean, sum(kept * row[n + 2 + k]) AS explained
        FROM (SELECT solved.study, length, i, solved.n, solved.row, unnest(range(0, 80)) AS k,
            unnest(cross_.row) AS kept FROM solved JOIN cross_ USING (study, length, i)
            SEMI JOIN chosen USING (study, length)) s GROUP BY s.study, k),
    gains AS (SELECT study, k, deviation * spread * CASE WHEN {z} < -8 THEN 0 WHEN {z} > 8 THEN {z}
            ELSE {z} * (0.5 + {density} * {series}) + {density} END AS gain
        FROM (SELECT study, k, mean, sqrt(greatest(1 - explained, 1e-12)) AS deviation, spread,
            (least - middle) / spread AS best FROM predicted JOIN studies USING (study))),
    top AS (SELECT study, arg_max(k, (gain, -k)) AS k, max(gain) AS gain FROM gains GROUP BY study)
    SELECT study, round(1.0::DOUBLE + u * 19.0::DOUBLE, 6) + 0.0 AS c, round(0.1::DOUBLE + v * 99.9::DOUBLE, 6) + 0.0 AS t,
        round(gain, 3) + 0.0 AS expected_improvement FROM top JOIN points USING (study, k)"""


def _within_sql() -> str:
    """40 of 64 parts of the cells of side 1, and the ratio estimate from them."""
    cell = "concat_ws(':', px, py)"
    part = f"floor({_hash_sql(cell, 7)} * 64)::INTEGER"
    quantile, scale = NormalDist().inv_cdf(0.95), 64 * 64 * (1 - 40 / 64) / 40 / 39
    return f"""{_placed_sql('purchases')},
    placed AS MATERIALIZED (SELECT id, x, y, floor(x)::BIGINT AS px, floor(y)::BIGINT AS py FROM layout),
    cells AS (SELECT px, py, count(*) AS w FROM placed GROUP BY px, py),
    ring(dx, dy) AS (VALUES (0, 0), (1, -1), (1, 0), (1, 1), (0, 1)),
    possible AS (SELECT {part} AS part, sum(CASE WHEN dx = 0 AND dy = 0 THEN a.w * (a.w - 1) // 2 ELSE a.w * b.w END) AS z
        FROM (SELECT px, py, w, dx, dy, px + dx AS qx, py + dy AS qy FROM cells, ring) a
        JOIN (SELECT px AS qx, py AS qy, w FROM cells) b USING (qx, qy) GROUP BY part),
    near AS (SELECT a.px, a.py, count(*) AS n FROM (SELECT * FROM placed, ring) a
        JOIN (SELECT id, x, y, px AS qx, py AS qy FROM placed) b ON b.qx = a.px + dx AND b.qy = a.py + dy
        AND (a.id < b.id OR dx <> 0 OR dy <> 0) AND {_CLOSE.format(r=0.5)} GROUP BY a.px, a.py),
    found AS (SELECT {part} AS part, sum(n) AS n FROM near GROUP BY part),
    counted AS (SELECT coalesce(n, 0)::DOUBLE AS n, z::DOUBLE AS z FROM possible LEFT JOIN found USING (part) WHERE part < 40),
    sums AS (SELECT sum(n) AS least, sum(z) AS seen, sum(n * n) AS nn, sum(n * z) AS nz, sum(z * z) AS zz,
        sum(n) / sum(z) AS ratio, (SELECT sum(z) FROM possible)::DOUBLE AS total FROM counted),
    about AS (SELECT *, least + ratio * (total - seen) AS about, least + (total - seen) AS most, {quantile}
        * sqrt(greatest(nn - 2 * ratio * nz + ratio * ratio * zz, 0) * {scale}) AS margin FROM sums)
    SELECT 0 AS trial, round(about, 4) AS node_occlusion, round(greatest(about - margin, least), 4) AS low,
        round(CASE WHEN about + margin < most THEN about + margin ELSE most END, 4) AS high, least::BIGINT AS least, most::BIGINT AS most, 0.625::DOUBLE AS share
    FROM about"""


def _raster_sql() -> str:
    def pixel(value: str) -> str:
        return f"least(floor({value}), 63)::INTEGER"

    return f"""{_placed_sql('geography')},
    frame AS (SELECT min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM layout),
    nodes AS (SELECT {pixel('(x - x0) / w * 64.0::DOUBLE')} AS px, {pixel('(y - y0) / h * 64.0::DOUBLE')} AS py,
        count(*) AS nodes FROM layout, frame GROUP BY 1, 2),
    scaled AS (SELECT src, dst, (x1 - x0) / w * 64.0::DOUBLE AS ax, (y1 - y0) / h * 64.0::DOUBLE AS ay,
        (x2 - x0) / w * 64.0::DOUBLE AS bx, (y2 - y0) / h * 64.0::DOUBLE AS by_ FROM located, frame),
    stepped AS (SELECT *, greatest(ceil(greatest(abs(bx - ax), abs(by_ - ay)))::INTEGER, 1) AS n FROM scaled),
    samples AS (SELECT *, unnest(range(0, n + 1)) AS i FROM stepped),
    hits AS (SELECT DISTINCT src, dst, {pixel('ax + (bx - ax) * i / n')} AS px,
        {pixel('ay + (by_ - ay) * i / n')} AS py FROM samples),
    counted AS (SELECT px, py, count(*) AS edges FROM hits GROUP BY 1, 2)
    SELECT 0 AS trial, px, py, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges
    FROM nodes FULL JOIN counted USING (px, py)"""


_PROGRESS_SQL = """WITH log AS (SELECT o_custkey AS run, l_orderkey * 10 + l_linenumber AS line_no,
        l_linenumber AS kind, (o_orderkey % 50)::BIGINT AS number, l_quantity::INTEGER AS done
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 5),
    last AS (SELECT run, arg_max(kind, line_no) AS kind,
        arg_max(number, line_no) FILTER (kind = 1) AS trial,
        max(line_no) FILTER (kind = 1) AS begun, max(line_no) FILTER (kind = 2) AS shown,
        arg_max(done, line_no) FILTER (kind = 2) AS done FROM log GROUP BY run)
    SELECT run, trial, CASE kind WHEN 1 THEN 'preparing' WHEN 2 THEN 'layout' WHEN 3 THEN 'node occlusion'
        WHEN 4 THEN 'edge crossing' WHEN 5 THEN 'drawing' END AS stage,
        floor(100 * trial / 50.0)::INTEGER AS percent,
        CASE WHEN shown > begun THEN done END AS layout_percent FROM last"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries it can check on whole tables.

    Left out: ``edge_crossing_angle_trade``, whose pairs are too many to list;
    the same operator has rows with SQL on the other graphs.
    """
    trade, purchases, geography = (
        _placed_sql("trade"),
        _placed_sql("purchases"),
        _placed_sql("geography"),
    )
    aim = math.radians(70.0)
    strips_sql = {g: _placed_sql(g) + _segments_sql(1.0) for g in ("trade", "geography")}
    pair_count = f"""{strips_sql['geography']} SELECT 0 AS trial, count(*) AS edge_crossing
        FROM segments a JOIN segments b ON {_CROSSING_ON}"""
    angle = f"sum(abs({aim}::DOUBLE - {_ACUTE})) / (count(*) * {aim}::DOUBLE)"
    variation = f"stddev_pop({_LENGTH}) / avg({_LENGTH}) / sqrt(count(*) - 1)"
    return (_llm.ORACLE_SQL if _llm else {}) | {
        "vertices": f"{trade} SELECT id FROM vertices",
        "edges_from_table": _EDGE_SQL["trade"],
        "edge_list_text": _EDGE_SQL["trade"],
        "layout_roundtrip": f"{purchases} SELECT trial, id, round(x, 6) AS x, round(y, 6) AS y FROM layout",
        "trials_roundtrip": f"{_ORDER_HISTORY_SQL} FROM orders",
        "edges_xy": f"""{purchases} SELECT trial, src, dst, round(x1, 6) AS x1, round(y1, 6) AS y1,
            round(x2, 6) AS x2, round(y2, 6) AS y2 FROM located""",
        "dangling_edges": f"""{geography} SELECT src, dst FROM edges
            WHERE src LIKE 'r%' OR dst LIKE 'r%'""",
        "message_degree_sum": f"""{trade} SELECT trial, id, count(*) AS degree, round(sum(m), 6) AS sum_x FROM (
            SELECT trial, src AS id, x2 AS m FROM located UNION ALL SELECT trial, dst, x1 FROM located)
            GROUP BY trial, id""",
        "vertex_pairs_count": f"{purchases} SELECT count(*) * (count(*) - 1) AS pairs FROM vertices",
        "random_layout": f"{purchases} SELECT trial, id, round(x, 6) AS x, round(y, 6) AS y FROM layout",
        "repulsive_forces": f"""{purchases} SELECT trial, id, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy
            FROM ({_repulsion_sql('layout', f'{_K}::DOUBLE')})""",
        "attractive_forces": f"""{geography} SELECT trial, id, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy
            FROM ({_attraction_sql('layout', f'{_K}::DOUBLE')})""",
        "net_forces": f"""{geography} SELECT trial, id, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy
            FROM ({_forces_sql('layout', f'{_K}::DOUBLE')})""",
        "layout_step1": _layout_sql(1),
        "layout_step2": _layout_sql(2),
        "force_layout_10": _layout_sql(10, _SHORT, 4),
        "node_occlusion_exact": _occlusion_sql("purchases", 1.0),
        "node_occlusion_grid": _occlusion_sql("purchases", 1.0),
        "node_occlusion_dense": _occlusion_sql("purchases", 0.2, 1.0),
        "occluded_pairs": f"""{purchases} SELECT 0 AS trial, a.id AS u, b.id AS v
            FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=0.25)}""",
        "node_occlusion_within": _within_sql(),
        "node_occlusion_hll": f"""{purchases} SELECT 0 AS trial, count(*) AS node_occlusion, true AS within
            FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=0.5)}""",
        "disc_cells": f"""{purchases}{_DISC_SQL} SELECT trial, id, round(x, 6) AS x, round(y, 6) AS y,
            cell_x, cell_y FROM discs""",
        "node_occlusion_cellsum": f"""{purchases}{_DISC_SQL} SELECT 0 AS trial, count(*) AS node_occlusion
            FROM discs a JOIN discs b ON a.cell_x = b.cell_x AND a.cell_y = b.cell_y
            AND a.id < b.id AND {_CLOSE.format(r=1.0)}""",
        "node_occlusion_sampled": f"""{purchases}, sampled AS MATERIALIZED (SELECT * FROM layout
            WHERE {_hash_sql('id', 7)} < 0.5::DOUBLE)
            SELECT 0 AS trial, count(*) / 0.25::DOUBLE AS node_occlusion
            FROM sampled a JOIN sampled b ON a.id < b.id AND {_CLOSE.format(r=1.0)}""",
        "strip_segments": f"""{strips_sql['geography']} SELECT trial, src, dst, part, round(ly, 6) AS ly,
            round(ry, 6) AS ry, round(theta, 6) + 0.0 AS theta FROM segments""",
        "strip_histogram": f"""{strips_sql['trade']} SELECT trial, part, count(*) AS segments
            FROM segments GROUP BY trial, part""",
        "edge_crossing_by_strip": f"""{strips_sql['trade']}{_inversions_sql()}
            SELECT trial, part, crossings FROM per_strip""",
        "edge_crossing_strips": f"""{strips_sql['trade']}{_inversions_sql()}
            SELECT 0 AS trial, sum(crossings)::BIGINT AS edge_crossing FROM per_strip""",
        "edge_crossing_strips_bitwise": pair_count,
        "edge_crossing_strips_chunked": pair_count,
        "edge_crossing_exact": _exact_sql("geography", False),
        "edge_crossing_proper": _exact_sql("geography", True),
        "edge_crossing_proper_trade": _exact_sql("trade", True),
        "crossing_pairs": f"""{strips_sql['geography']} SELECT a.trial, a.part, a.src AS a_src, a.dst AS a_dst,
            b.src AS b_src, b.dst AS b_dst, round({_ACUTE}, 6) AS theta
            FROM segments a JOIN segments b ON {_CROSSING_ON}""",
        "edge_crossing_angle": f"""{strips_sql['geography']} SELECT 0 AS trial, round({angle}, 6)
            AS edge_crossing_angle FROM segments a JOIN segments b ON {_CROSSING_ON}""",
        "edge_crossing_angle_purchases": f"""{purchases}{_segments_sql(10.0)} SELECT 0 AS trial,
            round({angle}, 6) AS edge_crossing_angle FROM segments a JOIN segments b ON {_CROSSING_ON}""",
        "edge_crossing_angle_chunked": f"""{strips_sql['geography']} SELECT 0 AS trial, round({angle}, 6)
            AS edge_crossing_angle FROM segments a JOIN segments b ON {_CROSSING_ON}""",
        "segments_meeting": f"""{geography}, pairs AS (SELECT a.src[2:] AS number,
            a.x1 AS ax, a.y1 AS ay, a.x2 AS bx, a.y2 AS by_, b.x1 AS cx, b.y1 AS cy, b.x2 AS dx, b.y2 AS dy
            FROM located a JOIN located b ON a.src LIKE 'c%' AND b.src LIKE 's%' AND a.src[2:] = b.src[2:]),
            sides AS (SELECT *,
            sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) AS s1,
            sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) AS s2
            FROM pairs)
            SELECT number, CASE WHEN s1 = 0 AND s2 = 0 THEN
                least((ax, ay), (bx, by_)) <= greatest((cx, cy), (dx, dy))
                AND least((cx, cy), (dx, dy)) <= greatest((ax, ay), (bx, by_))
                ELSE s1 <= 0 AND s2 <= 0 END AS meet, s1 < 0 AND s2 < 0 AS cross FROM sides""",
        "vertex_angles": f"""{trade}{_DIRECTIONS_SQL} SELECT trial, id, degree, round(min_gap, 6) AS min_gap,
            round(deviation, 6) + 0.0 AS deviation FROM deviations""",
        "minimum_angle": f"""{trade}{_DIRECTIONS_SQL} SELECT trial, round(1 - avg(deviation), 6)
            AS minimum_angle FROM deviations GROUP BY trial""",
        "edge_lengths": f"""{purchases} SELECT trial, src, dst, round({_LENGTH}, 6) AS length FROM located""",
        "edge_length_variation": f"""{trade} SELECT trial, round({variation}, 6) AS edge_length_variation
            FROM located GROUP BY trial""",
        "readability_report": f"""{strips_sql['geography']}{_DIRECTIONS_SQL} SELECT 0 AS trial,
            (SELECT count(*) FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=1.0)})
                AS node_occlusion,
            (SELECT count(*) FROM segments a JOIN segments b ON {_CROSSING_ON}) AS edge_crossing,
            (SELECT round({angle}, 6) FROM segments a JOIN segments b ON {_CROSSING_ON})
                AS edge_crossing_angle,
            (SELECT round(1 - avg(deviation), 6) FROM deviations) AS minimum_angle,
            (SELECT round({variation}, 6) FROM located) AS edge_length_variation""",
        "layout_raster": _raster_sql(),
        "random_baseline": f"""{geography}{_segments_sql(0.1)} SELECT 0 AS trial,
            (SELECT count(*) FROM layout a JOIN layout b ON a.id < b.id AND {_CLOSE.format(r=1.0)}) AS nc,
            (SELECT count(*) FROM segments a JOIN segments b ON {_CROSSING_ON}) AS ec""",
        "trial_candidates": f"""SELECT o_orderkey AS trial,
            round(1.0::DOUBLE + {_hash_sql('o_orderkey', 42)} * 19.0::DOUBLE, 6) AS c,
            round(0.1::DOUBLE + {_hash_sql('o_orderkey', 43)} * 99.9::DOUBLE, 6) AS t FROM orders""",
        "evaluate_trials_step1": _evaluate_sql(),
        "list_trials": f"SELECT h.*, o_custkey AS study FROM orders, LATERAL ({_ORDER_HISTORY_SQL}) h",
        "best_trial": f"""SELECT h.*, o_custkey AS study FROM orders, LATERAL ({_ORDER_HISTORY_SQL}) h
            ORDER BY score NULLS LAST, trial LIMIT 1""",
        "best_trial_by_study": f"""SELECT h.*, o_custkey AS study FROM orders, LATERAL ({_ORDER_HISTORY_SQL}) h
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score NULLS LAST, trial) = 1""",
        "sweep": f"{_sweep_sql()} {_SCORED.format(n='')}",
        "sweep_history": f"{_sweep_sql()} {_SCORED.format(n='')}",
        "sweep_best_layout": f"""{_sweep_sql()} SELECT trial, id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y
            FROM (SELECT * FROM step1 UNION ALL SELECT * FROM step2)
            WHERE trial = (SELECT trial FROM scored ORDER BY score NULLS LAST, trial LIMIT 1)""",
        "proposed_trials": _proposed_sql(),
        "trial_progress": _PROGRESS_SQL,
        "stream_trials": """SELECT count(*) AS trials, min(o_totalprice) AS best_score,
            arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best_trial FROM orders""",
    }
