"""The count of close pairs that stops in time."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from lucidgraph.operators import occlusion
from lucidgraph.operators.layout import random_layout
from lucidgraph.operators.occlusion import node_occlusion, node_occlusion_within
from lucidgraph.session import materialize


@pytest.fixture(scope="module")
def layouts(spark):
    """Eight layouts of 900 vertices, the last one with a crowd in one cell."""
    vertices = spark.range(900).select(F.col("id").cast("string").alias("id"))
    rows = random_layout(vertices.crossJoin(spark.range(8).withColumnRenamed("id", "trial")), 30.0)
    rows = rows.select("trial", "id", *[
        (F.col(c) + F.lit(3.7) * F.col("trial") * F.col("trial")).alias(c) for c in ("x", "y")
    ])
    crowd = spark.range(700).select(
        F.lit(7).cast("bigint").alias("trial"),
        F.concat(F.lit("more"), "id").alias("id"),
        (F.lit(190.0) + F.col("id") % 25 / 40).alias("x"),
        (F.lit(190.0) + F.floor(F.col("id") / 50) / 40).alias("y"),
    )
    return materialize(rows.unionByName(crowd))


@pytest.fixture(scope="module")
def exact(layouts):
    return {r.trial: r.node_occlusion for r in node_occlusion(layouts, 1.0).collect()}


def test_a_part_bounds_and_estimates_the_whole(layouts, exact):
    found = node_occlusion_within(layouts, 1.0, None, 0.95, at_most=32).collect()
    assert {r.trial for r in found} == set(exact) and all(r.share == 0.5 for r in found)
    for r in found:
        assert r.least <= exact[r.trial] <= r.most
        assert r.least <= r.low <= r.node_occlusion <= r.high <= r.most
    # the layouts come from a hash, so this does not depend on luck
    assert sum(r.low <= exact[r.trial] <= r.high for r in found) >= 7
    assert all(abs(r.node_occlusion - exact[r.trial]) < 0.25 * exact[r.trial] for r in found)


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_all_parts_are_the_exact_count(layouts, exact, parts):
    for r in node_occlusion_within(layouts, 1.0, None, parts=parts).collect():
        assert r.node_occlusion == r.low == r.high == r.least == r.most == exact[r.trial]
        assert r.share == 1.0


def test_no_time_leaves_the_bounds(layouts, exact):
    for r in node_occlusion_within(layouts, 1.0, timeout_ms=0).collect():
        assert (r.node_occlusion, r.low, r.least, r.share) == (None, 0.0, 0, 0.0)
        assert r.high == r.most >= exact[r.trial]


def test_one_part_has_no_interval_of_its_own(layouts, exact):
    for r in node_occlusion_within(layouts, 1.0, None, at_most=1).collect():
        assert (r.low, r.high) == (r.least, r.most) and r.least <= exact[r.trial] <= r.most


def test_late_jobs_are_cancelled(spark):
    def slow():
        rows = spark.range(8).repartition(8).rdd.map(lambda r: time.sleep(30) or 1)
        return rows.collect()

    begin = time.monotonic()
    assert occlusion._until(begin + 1, spark, slow) is None
    assert time.monotonic() - begin < 15
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert occlusion._until(math.inf, spark, lambda: 7) == 7
    with pytest.raises(ZeroDivisionError):
        occlusion._until(math.inf, spark, lambda: 1 // 0)


def test_no_vertices(layouts):
    assert node_occlusion_within(layouts.limit(0), 1.0, None).count() == 0
