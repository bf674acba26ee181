"""Strips are counted so many at a time, and what a batch has moved goes before the next."""

import random

import pytest
from pyspark.sql import functions as F

from lucidgraph.operators import crossing
from lucidgraph.operators.crossing import edge_crossing_angle, edge_crossing_by_strip, edge_crossing_strips
from lucidgraph.session import materialize

from . import brute


def graph(seed=8, m=90):
    rng = random.Random(seed)
    positions = {f"v{i}": (rng.random() * 4 - 2, rng.random() * 3) for i in range(60)}
    return positions, [tuple(rng.sample(sorted(positions), 2)) for _ in range(m)]


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before
    assert {tuple(r) for r in kept.collect()} == {(k, len(range(k, 1000, 7))) for k in range(7)}


def spied(monkeypatch):
    """How many pieces each batch has."""
    seen, cut = [], crossing.cut_into_strips

    def spy(lines, g, *batch):
        pieces = cut(lines, g, *batch)
        if batch:
            seen.append(pieces.count())
        return pieces

    monkeypatch.setattr(crossing, "cut_into_strips", spy)
    return seen


@pytest.mark.parametrize("max_rows", [8, 70])
def test_strips_are_counted_in_batches(make, monkeypatch, max_rows):
    positions, pairs = graph()
    edges, layout = make(positions, pairs, trials=(0, 5))
    whole = sorted(map(tuple, edge_crossing_by_strip(layout, edges, 0.5).collect()))
    moved = spied(monkeypatch)
    monkeypatch.setattr(crossing, "BATCH_BYTES", 100 * crossing._COUNT_BYTES)
    found = edge_crossing_by_strip(layout, edges, 0.5, max_rows=max_rows, chunk_rows=9)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == len(set(whole)) > 10
    assert len(moved) > 3 and max(moved) < sum(moved) / 2
    total = edge_crossing_strips(layout, edges, 0.5, max_rows=max_rows, chunk_rows=9).collect()
    assert {r.trial: r.edge_crossing for r in total} == dict.fromkeys((0, 5), brute.strip_crossings(positions, pairs, 0.5)[0])


@pytest.mark.parametrize("max_rows", [8, 70])
def test_angles_are_added_up_in_batches(make, monkeypatch, max_rows):
    edges, layout = make(*graph(3))
    whole = edge_crossing_angle(layout, edges, g=0.5).head()[-1]
    moved = spied(monkeypatch)
    monkeypatch.setattr(crossing, "BATCH_BYTES", 60 * crossing._ANGLE_BYTES)
    found = edge_crossing_angle(layout, edges, g=0.5, max_rows=max_rows, chunk_rows=9)
    assert found.head()[-1] == pytest.approx(whole, rel=1e-9)
    assert len(moved) > 2 and max(moved) < sum(moved) / 2
