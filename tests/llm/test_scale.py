"""What travels and how many tasks read: archives by ranges, vectors as codes."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lucidgraph.llm import ann, warc

from . import brute as B
from .test_operators import same


def test_packages_are_read_by_many_tasks(spark, tmp_path):
    random_ = random.Random(3)
    pages = [(i, f"http://h/{i}", f"{i} " + random_.randbytes(3000).hex()) for i in range(160)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    packages = warc.write_packages(frame, f"{tmp_path}/w", package_bytes=30_000)
    assert packages.count() >= 16
    read = warc.read_packages(packages)
    assert read.rdd.getNumPartitions() >= 16
    tasks = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 12 and max(r["count"] for r in tasks) <= 40
    same(
        read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
        B.warc([(p, h) for p, _, h in pages]),
    )


def vectors(n, seed, dims=24):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(12, dims))
    return centres[random_.integers(0, 12, n)] + 0.15 * random_.normal(size=(n, dims))


def test_nearest_of_clusters_and_copies(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(500, 1))]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000, [-x for x in rows[7][1]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for options in ({}, dict(candidate_rows=90, query_rows=3)):
        same(ann.nearest(frame, F.col("vec_id") % 50 == 0, **options), B.nearest(rows))


def test_copies_leave_few_candidates(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(500 + i, [float(i), 1.0, 0.5]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    assert ann._distinct(frame, 5).count() == 26


def test_a_tile_keeps_the_nearest_and_drops_the_far():
    points = vectors(3000, 2)
    codes, scale, lost = ann.quantised(ann._unit(points))
    table = pa.table(
        {"vec_id": np.arange(3000), "codes": [c.tobytes() for c in codes], "scale": scale, "lost": lost}
    )
    found = ann.tile(table.slice(0, 40), table, 5).to_pandas()
    unit = ann._unit(points)
    true = unit[:40] @ unit.T
    np.fill_diagonal(true, -math.inf)
    for q, own in found.groupby("query_id"):
        assert set(np.argsort(-true[q])[:5]) <= set(own.vec_id)
        values = true[q][own.vec_id]
        assert (own.low <= values + 1e-12).all() and (values <= own.high + 1e-12).all()
    # most pairs stay in the tile
    assert len(found) < 0.1 * 40 * 3000
