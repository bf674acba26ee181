"""Strips in chunks: pieces travel once to either chunk, and nothing else of their number moves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidgraph.functions.hinges import deviation_totals
from lucidgraph.operators.crossing import edge_crossing_angle, edge_crossing_by_strip
from lucidgraph.plans import packets


def brute(rows):
    found = {}
    for strip, ly, ry, w in rows:
        found.setdefault(strip, []).append((ly, ry, w))
    return {
        s: sum(p[2] * q[2] for p in r for q in r if p[0] < q[0] and p[1] > q[1])
        for s, r in found.items()
    }


@pytest.mark.parametrize("ties, chunk_rows, pack", [(0, 7, 1_000_000), (5, 7, 40), (12, 60, 100), (0, 500, 30)])
def test_packets_count_inversions(spark, monkeypatch, ties, chunk_rows, pack):
    monkeypatch.setattr(packets, "PACK_ROWS", pack)
    rng = random.Random(4)
    height = (lambda: float(rng.randrange(ties))) if ties else (lambda: rng.random() - 0.5)
    rows = [(rng.choice("abc"), height(), height(), rng.choice((1, 1, 3))) for _ in range(200)]
    pieces = spark.createDataFrame(rows, "part string, ly double, ry double, w long")
    found = packets.inverted_in_packets(pieces, ["part"], 1_000, chunk_rows)
    assert {r.part: r.pairs for r in found.collect()} == brute(rows)


def test_one_height_for_too_many_is_left_to_the_other_plan(spark):
    rows = [("a", 0.0, float(i), 1) for i in range(50)]
    pieces = spark.createDataFrame(rows, "part string, ly double, ry double, w long")
    assert packets.inverted_in_packets(pieces, ["part"], 10, 10) is None


def test_chunked_strips_move_packets(make):
    rng = random.Random(8)
    positions = {f"v{i}": (rng.random() * 3, rng.random() * 3) for i in range(60)}
    pairs = [tuple(rng.sample(sorted(positions), 2)) for _ in range(90)]
    edges, layout = make(positions, pairs)
    whole = edge_crossing_by_strip(layout, edges, 0.5)
    cut = edge_crossing_by_strip(layout, edges, 0.5, max_rows=8, chunk_rows=9)
    moved = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in moved and "binary" not in whole.schema.simpleString()
    assert "MapInArrow" in moved
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    assert whole.agg(F.sum("crossings")).head()[0] > 0


@pytest.mark.parametrize("ties, chunk_rows, pack", [(0, 7, 4_000), (5, 7, 160), (12, 60, 400), (0, 500, 120)])
def test_packets_add_up_deviations(spark, monkeypatch, ties, chunk_rows, pack):
    monkeypatch.setattr(packets, "PACK_ROWS", pack)
    rng = random.Random(6)
    height = (lambda: float(rng.randrange(ties))) if ties else (lambda: 4 * rng.random() - 2)
    rows = []
    for _ in range(200):
        ly, ry = height(), height()
        rows.append((rng.choice("abc"), ly, ry, math.atan2(ry - ly, 1.0), rng.choice((1, 1, 3))))
    pieces = spark.createDataFrame(rows, "part string, ly double, ry double, theta double, w long")
    aim = math.radians(70)
    found = packets.deviations_in_packets(pieces, ["part"], aim, 1_000, chunk_rows)
    got = {r.part: (r.crossings, r.deviation) for r in found.collect()}
    for part in "abc":
        columns = zip(*(r[1:] for r in rows if r[0] == part))
        n, total = deviation_totals(*(np.array(c) for c in columns), aim)
        assert got[part] == (n, pytest.approx(total, rel=1e-9, abs=1e-6)) and n > 0


def test_angles_in_chunks_move_packets(make):
    rng = random.Random(8)
    positions = {f"v{i}": (rng.random() * 3, rng.random() * 3) for i in range(60)}
    pairs = [tuple(rng.sample(sorted(positions), 2)) for _ in range(90)]
    edges, layout = make(positions, pairs)
    whole = edge_crossing_angle(layout, edges, g=0.5)
    cut = edge_crossing_angle(layout, edges, g=0.5, max_rows=8, chunk_rows=9)
    assert "MapInArrow" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.head()[-1] == pytest.approx(whole.head()[-1], rel=1e-9)
