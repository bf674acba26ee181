"""Seeded random layouts and the force-directed layout.

A vertex v feels m * k^2/d away from every other vertex (m = 2: each pair acts
in both directions) and d^2/k toward each neighbour; a step moves it along the
sum of both by at most t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import unit_hash
from ..plans.multipole import inverse_sums
from ..session import Steps
from .messages import BY, aggregate_messages

# buckets by which vertices meet trials
_BUCKETS = 64


def random_layout(
    vertices: DataFrame,
    scale: float = 1.0,
    seeds: tuple[int, int] = (42, 41),
    trial: int = 0,
) -> DataFrame:
    """Uniform positions in a square of side ``scale``, from the id and two seeds.

    ``vertices`` may carry a ``trial`` column; otherwise it is set to ``trial``.
    """
    out = vertices if "trial" in vertices.columns else vertices.withColumn("trial", F.lit(trial))
    size = F.lit(float(scale))
    return out.withColumns(
        {f: unit_hash(F.col("id"), s) * size for f, s in zip(("x", "y"), seeds)}
    ).select("trial", "id", "x", "y")


def vertex_pair_count(vertices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of ordered pairs of different vertices, n(n-1), without forming them."""
    n = F.count("*")
    return vertices.groupBy(*by).agg((n * (n - 1)).alias("pairs"))


def ideal_length(n, c, width: float = 100.0, height: float = 100.0) -> Column:
    """k = C * sqrt(width * height / n); ``n`` and ``c`` are columns or numbers."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    c = c if isinstance(c, Column) else F.lit(float(c))
    return c * F.sqrt(F.lit(float(width * height)) / n)


def _expr(value) -> Column:
    """A number, or the name of a column of the layout."""
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def repulsive_forces(
    layout: DataFrame, k, m: float = 2.0, by: Sequence[str] = BY
) -> DataFrame:
    """``by, id, fx, fy``; coincident vertices do not repel each other."""
    by = list(by)
    spots = layout.groupBy(*by, "x", "y").agg(F.count("*").alias("w"))
    sums = inverse_sums(spots, by)
    strength = F.lit(float(m)) * _expr(k) * _expr(k)
    return layout.join(sums, [*by, "x", "y"], "left").select(
        *by,
        "id",
        F.coalesce(strength * F.col("fx"), F.lit(0.0)).alias("fx"),
        F.coalesce(strength * F.col("fy"), F.lit(0.0)).alias("fy"),
    )


def attractive_forces(
    layout: DataFrame, edges: DataFrame, k, by: Sequence[str] = BY
) -> DataFrame:
    """``by, id, fx, fy`` for vertices with an edge; a repeated edge pulls again."""
    c = F.col
    ends = layout.select(*by, "id", "x", "y", _expr(k).alias("k"))
    dx, dy = c("dst_x") - c("src_x"), c("dst_y") - c("src_y")
    d = F.sqrt(dx * dx + dy * dy)
    pull = F.struct((dx * d / c("src_k")).alias("fx"), (dy * d / c("src_k")).alias("fy"))
    back = F.struct((-(dx * d / c("src_k"))).alias("fx"), (-(dy * d / c("src_k"))).alias("fy"))
    sums = [F.sum("msg.fx").alias("fx"), F.sum("msg.fy").alias("fy")]
    return aggregate_messages(ends, edges, sums, to_src=pull, to_dst=back, by=by)


def net_forces(repulsive: DataFrame, attractive: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return (
        repulsive.unionByName(attractive)
        .groupBy(*by, "id")
        .agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    )


def apply_forces(
    layout: DataFrame, forces: DataFrame, t, by: Sequence[str] = BY
) -> DataFrame:
    """Move every vertex along its force by at most ``t``; no force, no move."""
    norm = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    step = F.try_divide(F.least(norm, _expr(t)), norm)

    def moved(axis: str) -> Column:
        return F.col(axis) + F.coalesce(F.col(f"f{axis}") * step, F.lit(0.0))

    kept = layout.columns
    return (
        layout.join(forces, [*by, "id"], "left")
        .withColumns({"x": moved("x"), "y": moved("y")})
        .select(*kept)
    )


def layout_step(
    layout: DataFrame, edges: DataFrame, k, t, m: float = 2.0, by: Sequence[str] = BY
) -> DataFrame:
    repulsive = repulsive_forces(layout, k, m, by)
    attractive = attractive_forces(layout, edges, k, by)
    return apply_forces(layout, net_forces(repulsive, attractive, by), t, by)


def as_trials(trials, spark) -> DataFrame:
    """``trial, c, t`` as a table, from a table or a sequence of such rows."""
    if not isinstance(trials, DataFrame):
        trials = spark.createDataFrame(list(trials), "trial bigint, c double, t double")
    return trials.select(F.col("trial").cast("bigint").alias("trial"), "c", "t")


def _start(vertices: DataFrame, trials: DataFrame, width: float, height: float) -> DataFrame:
    """One copy of the vertices per trial, with its ideal length and step limit.

    Trials and vertices meet by a hash bucket of the vertices, so either may be large.
    """
    n = F.lit(float(max(vertices.count(), 1)))
    buckets = F.explode(F.sequence(F.lit(0), F.lit(_BUCKETS - 1)))
    params = trials.select(
        "trial", ideal_length(n, F.col("c"), width, height).alias("k"), "t", buckets.alias("bucket")
    )
    placed = random_layout(vertices.select("id")).drop("trial")
    bucket = F.pmod(F.xxhash64("id"), F.lit(_BUCKETS)).cast("int")
    return (
        placed.withColumn("bucket", bucket)
        .join(params, "bucket")
        .select("trial", "id", "x", "y", "k", "t")
    )


def force_layouts(
    vertices: DataFrame,
    edges: DataFrame,
    trials: DataFrame | Sequence[tuple[int, float, float]],
    iterations: int = 10,
    width: float = 100.0,
    height: float = 100.0,
    m: float = 2.0,
) -> DataFrame:
    """``trial, id, x, y``: one layout per (trial, C, t), all in the same jobs.

    Each iteration is written to the checkpoint folder, so a lost executor
    costs a part of one iteration; the iteration before is then deleted.
    """
    spark = edges.sparkSession
    step = Steps(spark, "layout")
    state = step.keep(_start(vertices, as_trials(trials, spark), width, height))
    for _ in range(iterations):
        state = step.keep(layout_step(state, edges, "k", "t", m))
    return state.select("trial", "id", "x", "y")


def force_layout(
    vertices: DataFrame,
    edges: DataFrame,
    c: float = 10.0,
    t: float = 100.0,
    iterations: int = 10,
    width: float = 100.0,
    height: float = 100.0,
    m: float = 2.0,
) -> DataFrame:
    """The layout for one pair of parameters, as trial 0."""
    return force_layouts(vertices, edges, [(0, float(c), float(t))], iterations, width, height, m)
