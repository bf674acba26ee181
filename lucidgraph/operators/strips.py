"""Edges cut at the vertical lines x = i*g into pieces that span a whole strip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import height_at, left_to_right, slope_angle
from .messages import BY, locate_edges


def cut_into_strips(lines: DataFrame, g: float, batch: int = 0, batches: int = 1) -> DataFrame:
    """One row per complete strip that a line (xl, yl)-(xr, yr) spans.

    Adds ``part`` (the strip number), ``ly, ry`` (heights on its borders) and
    ``theta``.  The partial pieces at both ends are left out, so a line that
    spans no whole strip yields nothing.  Of several ``batches``, ``batch`` has every so
    many strips; only their pieces are made.
    """
    size = F.lit(float(g))
    begin = F.ceil(F.col("xl") / size).cast("bigint")
    end = F.floor(F.col("xr") / size).cast("bigint") - 1
    if batches > 1:
        begin += F.pmod(F.lit(batch) - begin, F.lit(batches))
    step = F.lit(batches).cast("bigint")
    spans = (F.col("xl") < F.col("xr")) & (begin <= end)
    carried = [c for c in lines.columns if c not in ("xl", "yl", "xr", "yr")]
    return (
        # sequence() counts down when the bounds cross, hence the filter first
        lines.where(spans)
        .select("*", F.explode(F.sequence(begin, end, step)).alias("part"))
        .select(
            *carried,
            "part",
            height_at(F.col("part") * size).alias("ly"),
            height_at((F.col("part") + 1) * size).alias("ry"),
            slope_angle().alias("theta"),
        )
    )


def strip_segments(
    layout: DataFrame, edges: DataFrame, g: float = 0.1, by: Sequence[str] = BY
) -> DataFrame:
    """``by, src, dst, part, ly, ry, theta``."""
    located = locate_edges(edges, layout, by)
    return cut_into_strips(located.select(*by, "src", "dst", *left_to_right()), g)


def distinct_lines(
    layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Located edges with equal geometry folded into one row with a weight ``w``.

    Copies of an edge, reversed or not, and edges between coincident vertices
    fold before anything is cut or compared.
    """
    located = locate_edges(edges, layout, by)
    return (
        located.select(*by, *left_to_right())
        .groupBy(*by, "xl", "yl", "xr", "yr")
        .agg(F.count("*").alias("w"))
    )


def strip_histogram(
    layout: DataFrame, edges: DataFrame, g: float = 0.1, by: Sequence[str] = BY
) -> DataFrame:
    """Segments per strip: the skew report."""
    pieces = cut_into_strips(distinct_lines(layout, edges, by), g)
    return pieces.groupBy(*by, "part").agg(F.sum("w").alias("segments"))
