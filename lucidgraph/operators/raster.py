"""Density images of a layout: vertices and edges per pixel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .messages import BY, framed, locate_edges


def _pixel(value: Column, size: int) -> Column:
    """Pixel of a coordinate in [0, size]; the far border belongs to the last one."""
    return F.least(F.floor(value), F.lit(size - 1)).cast("int")


def layout_raster(
    layout: DataFrame,
    edges: DataFrame,
    width: int = 100,
    height: int = 100,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``by, px, py, nodes, edges`` for every pixel that anything falls on.

    The image is the bounding box of each layout.  An edge is sampled once per
    pixel along its longer side and counts once in each pixel it hits.
    """
    by = list(by)
    frame = layout.groupBy(*by).agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") - F.min("x")).alias("w"),
        (F.max("y") - F.min("y")).alias("h"),
    )

    def across(x: Column) -> Column:
        return F.coalesce(F.try_divide(x - F.col("x0"), F.col("w")), F.lit(0.0)) * float(width)

    def down(y: Column) -> Column:
        return F.coalesce(F.try_divide(y - F.col("y0"), F.col("h")), F.lit(0.0)) * float(height)

    # counted per pixel before anything moves; the image bounds the result
    nodes = (
        framed(layout, frame, by, "id")
        .groupBy(
            *by,
            _pixel(across(F.col("x")), width).alias("px"),
            _pixel(down(F.col("y")), height).alias("py"),
        )
        .agg(F.count("*").alias("nodes"))
    )
    located = framed(locate_edges(edges, layout, by), frame, by, "src", "dst").select(
        *by,
        across(F.col("x1")).alias("ax"),
        down(F.col("y1")).alias("ay"),
        across(F.col("x2")).alias("bx"),
        down(F.col("y2")).alias("by_"),
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    steps = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy))).cast("int"), F.lit(1))
    hit = F.transform(
        F.sequence(F.lit(0), F.col("steps")),
        lambda i: F.struct(
            _pixel(F.col("ax") + dx * i / F.col("steps"), width).alias("px"),
            _pixel(F.col("ay") + dy * i / F.col("steps"), height).alias("py"),
        ),
    )
    lines = (
        located.withColumn("steps", steps)
        .select(*by, F.inline(F.array_distinct(hit)))
        .groupBy(*by, "px", "py")
        .agg(F.count("*").alias("edges"))
    )
    pixel = [*by, "px", "py"]
    none = F.lit(0).cast("bigint")
    both = nodes.withColumn("edges", none).unionByName(lines.withColumn("nodes", none))
    return both.groupBy(*pixel).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
