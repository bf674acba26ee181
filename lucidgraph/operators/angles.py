"""Minimum incident angle per vertex.

A vertex of very high degree must not be sorted in one task, so directions are
cut by ranges: gaps are taken inside each (vertex, range), then between
neighbouring ranges, of which there are as many as partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranks import in_ranges
from .messages import BY, messages

_TURN = 2 * math.pi


def incident_directions(
    layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Directions of the edges leaving each vertex: ``by, id, angle, n``.

    Equal directions are one row with a count, so copies of an edge fold
    together before the rows move.
    """
    c = F.col
    to_dst = F.atan2(c("src_y") - c("dst_y"), c("src_x") - c("dst_x"))
    to_src = F.atan2(c("dst_y") - c("src_y"), c("dst_x") - c("src_x"))

    def fold(angle):
        # 0.0 is added so that -0.0 and 0.0 are one direction
        return F.when(angle >= 0, angle).otherwise(angle + _TURN) + F.lit(0.0)

    by = list(by)
    return (
        messages(layout.select(*by, "id", "x", "y"), edges, fold(to_src), fold(to_dst), by)
        .groupBy(*by, "id", F.col("msg").alias("angle"))
        .agg(F.count("*").alias("n"))
    )


def vertex_angles(layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``by, id, degree, min_gap, deviation`` for every vertex with an edge."""
    by = list(by)
    vertex = [*by, "id"]
    # a hub's directions are cut by ranges, however narrow the cone they lie in
    directions = in_ranges(incident_directions(layout, edges, by), vertex, ["angle"], "cut")
    in_cut = Window.partitionBy(*vertex, "cut").orderBy("angle")
    cuts = (
        directions.withColumn("gap", F.col("angle") - F.lag("angle").over(in_cut))
        .groupBy(*vertex, "cut")
        .agg(
            F.sum("n").alias("degree"),
            F.least(F.min("gap"), F.when(F.max("n") > 1, 0.0)).alias("gap"),
            F.min("angle").alias("first"),
            F.max("angle").alias("last"),
        )
    )
    across = Window.partitionBy(*vertex).orderBy("cut")
    ideal = _TURN / F.col("degree")
    return (
        cuts.withColumn("gap", F.least("gap", F.col("first") - F.lag("last").over(across)))
        .groupBy(*vertex)
        .agg(
            F.sum("degree").alias("degree"),
            F.least(F.min("gap"), _TURN - (F.max("last") - F.min("first"))).alias("min_gap"),
        )
        .withColumn("deviation", (ideal - F.col("min_gap")) / ideal)
    )


def minimum_angle(layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """1 minus the mean deviation from evenly spread edges; 1 is best."""
    return (
        vertex_angles(layout, edges, by)
        .groupBy(*by)
        .agg((1.0 - F.avg("deviation")).alias("minimum_angle"))
    )
