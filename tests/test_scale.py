"""Crowds, ties, hubs and many trials: what small random graphs do not show."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lucidgraph.operators import search
from lucidgraph.operators.angles import vertex_angles
from lucidgraph.operators.crossing import crossing_pairs, edge_crossing_by_strip
from lucidgraph.operators.layout import force_layouts, repulsive_forces
from lucidgraph.operators.occlusion import node_occlusion, occluded_pairs
from lucidgraph.operators.progress import read_log, trial_progress
from lucidgraph.plans import cells, multipole
from lucidgraph.plans.ranks import dense_ranks, in_ranges
from lucidgraph.sources import read_trials, vertices_of

from .conftest import value


def test_crowds_at_the_edge_of_reach(make):
    # two crowds far smaller than the distance that decides about them
    crowd = {f"a{i}": (i * 1e-14, 0) for i in range(200)}
    crowd |= {f"b{i}": (2 + i * 4.441e-16, 0) for i in range(200)}
    _, layout = make(crowd, [])
    points = list(crowd.values())
    want = sum(
        (a[0] - b[0]) * (a[0] - b[0]) < 4.0 for i, a in enumerate(points) for b in points[i + 1 :]
    )
    assert value(node_occlusion(layout, 1.0)) == want == 78_812


def test_cells_are_told_apart_at_any_level(spark, monkeypatch):
    from lucidgraph.operators.occlusion import _cell_distance

    for level in (1, 20, 30, 31, 32, 48, 60):
        side = 1 << level
        rows = [(0, 0, 0, 0), (0, 0, side // 2, 0), (0, 0, side + 1, 0), (0, 0, 2 * side, side), (0, 0, 1 << 62, 3)]
        every, none = _cell_distance(level)
        pairs = spark.createDataFrame(rows, "px long, py long, qx long, qy long")
        found = [tuple(r) for r in pairs.select(every.alias("e"), none.alias("n")).collect()]
        if level >= 20:
            assert found[0][0] and found[1][0] and found[3] == found[4] == (False, True)
            assert not found[2][0] and not found[2][1]  # on the boundary: undecided


def test_pairs_of_a_crowd(make, monkeypatch):
    monkeypatch.setattr(cells, "PAIR_BUDGET", 16)
    positions = {f"a{i}": (0.5, 0.5) for i in range(6)} | {f"b{i}": (0.5 + i / 10, 0.7) for i in range(9)}
    _, layout = make(positions, [])
    got = {(r.u, r.v) for r in occluded_pairs(layout, 0.2).collect()}
    ids = sorted(positions)
    want = {
        (a, b) for a in ids for b in ids
        if a < b and math.dist(positions[a], positions[b]) < 0.4
    }
    assert got == want


def test_copies_of_an_edge_cross_like_one(spark):
    rows = [(0, "l", 0.0, 0.0), (0, "r", 1.0, 1.0), (0, "p", 0.0, 1.0), (0, "q", 1.0, 0.0)]
    layout = spark.createDataFrame(rows, "trial int, id string, x double, y double")
    edges = spark.createDataFrame([("l", "r")] * 150 + [("p", "q"), ("l", "q")], "src string, dst string")
    found = crossing_pairs(layout, edges, 1.0).collect()
    assert len(found) == 150 and {(r.b_src, r.b_dst) for r in found} == {("p", "q")}


def test_hub_with_a_narrow_cone(make):
    positions = {"hub": (0, 0)} | {f"v{i:04}": (1e6, i) for i in range(2000)}
    edges, layout = make(positions, [("hub", f"v{i:04}") for i in range(2000)])
    hub = vertex_angles(layout, edges).where("id = 'hub'").head()
    angles = [math.atan2(i, 1e6) for i in range(2000)]
    assert hub.degree == 2000
    assert hub.min_gap == pytest.approx(min(b - a for a, b in zip(angles, angles[1:])), rel=1e-9)


def test_dense_ranks(spark):
    rows = [(i % 3, float(i * i % 17)) for i in range(300)]
    found = dense_ranks(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", "r").collect()
    for k in range(3):
        order = sorted({x for key, x in rows if key == k})
        assert {(r.x, r.r) for r in found if r.k == k} == {(x, i) for i, x in enumerate(order)}
    assert len(found) == 300


def test_twenty_thousand_trials(make, spark):
    edges, _ = make({"a": (0, 0)}, [("a", "b")])
    trials = search.trial_candidates(spark.range(20_000).withColumnRenamed("id", "trial"))
    big = trials.withColumn("trial", F.col("trial") + (1 << 40))
    layouts = force_layouts(vertices_of(edges), edges, big, iterations=0)
    found = search.evaluate_trials(vertices_of(edges), edges, big, layouts=layouts, r=1.0, g=0.1)
    assert found.count() == 20_000 and found.where("nc = 1").count() == 20_000


def test_a_search_goes_on_where_it_stopped(make, spark, tmp_path):
    edges, _ = make({"a": (0, 0)}, [("a", "b"), ("b", "c"), ("c", "d")])
    vertices, path = vertices_of(edges), str(tmp_path / "search")
    options = dict(per_round=2, keep=1, iterations=1, r=1.0, g=0.5, path=path)
    first = search.sweep(vertices, edges, rounds=1, **options).collect()
    # a round that was interrupted has layouts and no history
    (tmp_path / "search" / "layouts" / "round=1" / "trial=9").mkdir(parents=True)
    both = search.sweep(vertices, edges, rounds=2, **options)
    rows = {r.trial: r for r in both.collect()}
    assert set(rows) == {0, 1, 2, 3} and all(rows[r.trial] == r for r in first)
    again = search.sweep(vertices, edges, rounds=2, **options).collect()
    assert {r.trial: r for r in again} == rows
    best = search.best_trial(read_trials(spark, search.history_path(path))).head().trial
    layout = search.best_layout(spark, path).collect()
    assert {r.id for r in layout} == set("abcd") and {r.trial for r in layout} == {best}
    status = trial_progress(read_log(spark, path), 4).head()
    assert (status.trial, status.stage, status.layout_percent) == (3, "drawing", 100)


def test_one_strip_is_sorted_in_parts(make, spark):
    """All segments in one strip: several cuts, a carried sum and no window over the strip."""
    rng = random.Random(12)
    positions = {f"l{i}": (0.0, float(rng.randrange(40))) for i in range(120)}
    positions |= {f"r{i}": (1.0, float(rng.randrange(40))) for i in range(120)}
    edges, layout = make(positions, [(f"l{rng.randrange(120)}", f"r{rng.randrange(120)}") for _ in range(400)])
    pairs = [(positions[r.src][1], positions[r.dst][1]) for r in edges.collect()]
    want = sum(a[0] < b[0] and a[1] > b[1] for a in pairs for b in pairs)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        rows = spark.createDataFrame(pairs, "ly double, ry double").selectExpr("0 AS part", "*", "1 AS w")
        assert in_ranges(rows, ["part"], ["ly", "ry"], "cut").select("cut").distinct().count() >= 4
        found = edge_crossing_by_strip(layout, edges, 1.0, plan="bitwise")
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        found = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [(r.part, r.crossings) for r in found] == [(0, want)]
    # the rows of each level come from cuts of the strip, not from one task for all of it
    dealt = [
        next(below for below in lines[i:] if " Exchange " in below)
        for i, line in enumerate(lines) if " Generate " in line
    ]
    assert sum("left_cut" in line for line in dealt) == sum("right_cut" in line for line in dealt) == 1


@pytest.mark.parametrize("rows", [0, 60, 10**6])
def test_points_of_crowded_cells_are_not_joined_in_pairs(make, monkeypatch, rows):
    """Crowds meet as rows of points; cells beyond what a task may hold are split before."""
    monkeypatch.setattr(cells, "PAIR_BUDGET", 16)
    monkeypatch.setattr(cells, "KERNEL_ROWS", rows)
    joined, point_pairs = [], cells.point_pairs

    def spy(points, pairs, level, by):
        found = point_pairs(points, pairs, level, by)
        joined.append(found.groupBy(*by, "px", "py", "qx", "qy").count())
        return found

    monkeypatch.setattr(cells, "point_pairs", spy)
    rng = random.Random(3)
    positions = {f"a{i}": (rng.random() * 4, rng.random() * 4) for i in range(220)}
    positions |= {f"b{i}": (1.5, 1.5) for i in range(5)}
    _, layout = make(positions, [], trials=(0, 3))
    points = list(positions.values())
    want = sum(
        (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < 4.0 for i, a in enumerate(points) for b in points[i + 1 :]
    )
    found = node_occlusion(layout, 1.0).collect()
    assert [(r.trial, r.node_occlusion) for r in sorted(found)] == [(0, want), (3, want)]
    assert joined and all(r["count"] <= 16 for df in joined for r in df.collect())
    if rows == 10**6:
        # no level beyond the first: nothing was split, so nothing was joined over again
        assert len(joined) == 1


def test_tables_of_the_repulsion_do_not_grow_with_the_levels(make, monkeypatch):
    """Points are written as packets of a leaf, and no level has tables of its own."""
    rng = random.Random(8)
    positions = {f"s{i}": (rng.random(), rng.random()) for i in range(300)}
    positions |= {f"c{i}": (0.7 + rng.random() / 100, 0.2 + rng.random() / 100) for i in range(300)}
    _, layout = make(positions, [])
    written, materialize = [], multipole.materialize

    def spy(df):
        written.append(materialize(df))
        return written[-1]

    monkeypatch.setattr(multipole, "materialize", spy)
    counts = []
    for budget in (10**6, 256):
        monkeypatch.setattr(cells, "PAIR_BUDGET", budget)
        assert repulsive_forces(layout, 1.0).count() == 600
        counts.append(len(written))
        leaves, packets = written[-2:]
        assert packets.count() == leaves.where("level = leaf").count() < 150
        written.clear()
    assert counts[0] == counts[1]
    # the crowd lies deeper than the level that all cells begin at
    assert leaves.agg(F.max("leaf")).head()[0] > multipole.START_LEVEL


def test_points_move_to_crowded_cells_in_batches(make, monkeypatch):
    """However many pairs of cells there are, so many points move at a time, and then their files go."""
    monkeypatch.setattr(cells, "PAIR_BUDGET", 16)
    monkeypatch.setattr(cells, "KERNEL_ROWS", 60)
    monkeypatch.setattr(cells, "MOVED_ROWS", 500)
    moved, kept, materialize = [], [], cells.materialize
    measured = cells._measured

    def spy(points, pairs, level, by, *rest):
        moved.append(pairs.count())
        return measured(points, pairs, level, by, *rest)

    monkeypatch.setattr(cells, "_measured", spy)
    monkeypatch.setattr(cells, "materialize", lambda df: kept.append(df) or materialize(df))
    rng = random.Random(3)
    positions = {f"a{i}": (rng.random() * 4, rng.random() * 4) for i in range(220)}
    _, layout = make(positions, [], trials=(0, 3))
    points = list(positions.values())
    want = sum(
        (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < 4.0 for i, a in enumerate(points) for b in points[i + 1 :]
    )
    found = node_occlusion(layout, 1.0).collect()
    assert [(r.trial, r.node_occlusion) for r in sorted(found)] == [(0, want), (3, want)]
    assert len(moved) > 3 and max(moved) < sum(moved) / 2
    assert sum("n" in df.columns for df in kept) == len(moved)
