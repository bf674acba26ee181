"""Edge lengths and their variation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .messages import BY, locate_edges


def edge_lengths(layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    xy = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return locate_edges(edges, layout, by).select(
        *by, "src", "dst", distance(*xy).alias("length")
    )


def edge_length_variation(
    layout: DataFrame, edges: DataFrame, by: Sequence[str] = BY
) -> DataFrame:
    """Population CV of the lengths over sqrt(m - 1); null for a single edge."""
    m = F.count("*").cast("double")
    cv = F.try_divide(F.stddev_pop("length"), F.avg("length"))
    return (
        edge_lengths(layout, edges, by)
        .groupBy(*by)
        .agg(F.try_divide(cv, F.sqrt(m - 1.0)).alias("edge_length_variation"))
    )
