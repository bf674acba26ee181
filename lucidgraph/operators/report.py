"""All readability metrics of every layout, one row each."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .angles import minimum_angle
from .crossing import edge_crossing_angle, edge_crossing_strips
from .exact_crossing import edge_crossing_exact
from .lengths import edge_length_variation
from .messages import BY
from .occlusion import node_occlusion_grid


def readability_report(
    layout: DataFrame,
    edges: DataFrame,
    r: float = 1.0,
    g: float = 0.1,
    g_angle: float = 1.0,
    ideal: float = 70.0,
    exact: bool = False,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``by`` and the five metrics; ``exact`` counts all crossings, not only
    those in whole strips."""
    by = list(by)
    # the metrics share the positions and the edges, which are written once
    layout, edges = materialize(layout), materialize(edges)
    crossing = (
        edge_crossing_exact(layout, edges, by=by)
        if exact
        else edge_crossing_strips(layout, edges, g, by)
    )
    metrics = [
        node_occlusion_grid(layout, r, by),
        crossing,
        edge_crossing_angle(layout, edges, ideal, g_angle, by),
        minimum_angle(layout, edges, by),
        edge_length_variation(layout, edges, by),
    ]
    # a row for each metric and layout, laid side by side; an edgeless layout has no angles
    names = [next(c for c in metric.columns if c not in by) for metric in metrics]
    rows = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), metrics
    )
    return rows.groupBy(*by).agg(*(F.max(name).alias(name) for name in names))
