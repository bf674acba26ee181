"""Search for layout parameters: trials evaluated side by side, as tables."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import unit_hash
from ..session import materialize, scratch_path
from ..sources.layouts import read_layout, write_layout
from ..sources.trials import TRIALS, read_trials, write_trials
from .crossing import edge_crossing_strips
from .guided import C_RANGE, T_RANGE, proposed_trials
from .layout import as_trials, force_layouts, random_layout
from .messages import BY
from .occlusion import node_occlusion
from .progress import Markers


def random_baseline(
    vertices: DataFrame,
    edges: DataFrame,
    r: float = 1.0,
    g: float = 0.1,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``by, nc, ec`` of a random layout of side 100: what a score is relative to.

    ``vertices`` may carry a ``trial``; then each has a baseline of its own.
    """
    return _counts(materialize(random_layout(vertices, 100.0)), edges, r, g, by)


def _side_by_side(nc: DataFrame, ec: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, nc, ec`` from the two counts of each layout."""
    none = F.lit(None).cast("bigint")
    rows = nc.select(*by, F.col("node_occlusion").alias("nc"), none.alias("ec")).unionByName(
        ec.select(*by, none.alias("nc"), F.col("edge_crossing").alias("ec"))
    )
    return rows.groupBy(*by).agg(F.max("nc").alias("nc"), F.max("ec").alias("ec"))


def _counts(
    layout: DataFrame, edges: DataFrame, r: float, g: float, by: Sequence[str]
) -> DataFrame:
    return _side_by_side(
        node_occlusion(layout, r, by), edge_crossing_strips(layout, edges, g, by), by
    )


def composite_score(
    nc: Column, ec: Column, nc0: Column, ec0: Column, capped: bool = False
) -> Column:
    """nc/nc0 + ec/ec0; null when a baseline is 0, lower is better.

    ``capped`` lets no share exceed 1.
    """
    if capped:
        nc, ec = F.least(nc, nc0), F.least(ec, ec0)
    return F.try_divide(nc, nc0) + F.try_divide(ec, ec0)


def trial_candidates(trials: DataFrame, seed: int = 42) -> DataFrame:
    """``trial, c, t``: a point of the searched ranges for every trial number."""

    def between(bounds, seed):
        low, high = bounds
        return F.lit(low) + unit_hash(F.col("trial"), seed) * F.lit(high - low)

    return trials.select(
        F.col("trial").cast("bigint").alias("trial"),
        between(C_RANGE, seed).alias("c"),
        between(T_RANGE, seed + 1).alias("t"),
    )


def evaluate_trials(
    vertices: DataFrame,
    edges: DataFrame,
    trials: DataFrame,
    baseline: DataFrame | None = None,
    iterations: int = 10,
    r: float = 1.0,
    g: float = 0.1,
    capped: bool = False,
    layouts: DataFrame | None = None,
    width: float = 100.0,
    height: float = 100.0,
) -> DataFrame:
    """A row of the trial history for every ``trial, c, t``.

    All layouts are made and measured together, however many there are; the times
    are the shares of one trial in the common jobs.
    """
    trials = as_trials(trials, edges.sparkSession)
    if layouts is None:
        layouts = force_layouts(vertices, edges, trials, iterations, width, height)
    if baseline is None:
        baseline = random_baseline(vertices.select("id"), edges, r, g)
    begin = time.monotonic()
    nc = materialize(node_occlusion(layouts, r))
    between = time.monotonic()
    ec = materialize(edge_crossing_strips(layouts, edges, g))
    end = time.monotonic()
    share = max(trials.count(), 1)
    base = baseline.select(F.col("nc").alias("nc0"), F.col("ec").alias("ec0")).head()
    nc0, ec0 = (F.lit(base.nc0), F.lit(base.ec0)) if base else (F.lit(None), F.lit(None))
    return (
        trials.join(_side_by_side(nc, ec, BY), "trial")
        .withColumns(
            {
                "nc_t": F.lit((between - begin) / share),
                "ec_t": F.lit((end - between) / share),
                "score": composite_score(F.col("nc"), F.col("ec"), nc0, ec0, capped),
            }
        )
        .select(*TRIALS.fieldNames())
    )


def list_trials(trials: DataFrame) -> DataFrame:
    return trials.orderBy("trial")


def best_trial(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The trial with the lowest score, the earliest of equals; without a score last.

    With ``by``, the best of each study.
    """
    rank = F.struct(F.col("score").isNull(), "score", "trial")
    if not by:
        return trials.orderBy(F.col("score").asc_nulls_last(), "trial").limit(1)
    best = F.min_by(F.struct(*[c for c in trials.columns if c not in by]), rank)
    return trials.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def _near(best: list, first: int, count: int, radius: float, spark, seed: int) -> DataFrame:
    """Candidates around the best trials so far, in a window of the given radius."""
    centres = F.array(
        *[F.struct(F.lit(b.c).alias("c"), F.lit(b.t).alias("t")) for b in best]
    )
    picked = spark.range(first, first + count).select(
        F.col("id").alias("trial"),
        F.get(centres, F.pmod(F.col("id"), F.lit(len(best))).cast("int")).alias("centre"),
    )

    def around(name, bounds, seed):
        low, high = bounds
        shift = (unit_hash(F.col("trial"), seed) - 0.5) * F.lit(2.0 * radius * (high - low))
        return F.least(
            F.greatest(F.col("centre")[name] + shift, F.lit(low)), F.lit(high)
        ).alias(name)

    return picked.select("trial", around("c", C_RANGE, seed), around("t", T_RANGE, seed + 1))


def next_trials(
    history: DataFrame, first: int, count: int, guide: str, keep: int, radius: float, seed: int
) -> DataFrame:
    """``trial, c, t`` of the trials ``first`` and on, from those before.

    ``guide="model"`` asks ``proposed_trials``; ``"near"`` draws around the ``keep`` best.
    """
    spark = history.sparkSession
    earlier = history.where((F.col("trial") < first) & F.col("score").isNotNull())
    if guide == "near":
        best = earlier.orderBy("score", "trial").limit(keep).collect()
        if best:
            return _near(best, first, count, radius, spark, seed)
    elif guide != "model":
        raise ValueError(guide)
    elif not earlier.isEmpty():
        trial = (F.lit(first) + F.col("place")).cast("bigint").alias("trial")
        return proposed_trials(earlier, count, seed=seed).select(trial, "c", "t")
    # nothing to go by
    return trial_candidates(spark.range(first, first + count).withColumnRenamed("id", "trial"), seed)


def sweep(
    vertices: DataFrame,
    edges: DataFrame,
    rounds: int = 5,
    per_round: int = 10,
    keep: int = 3,
    seed: int = 42,
    iterations: int = 10,
    r: float = 1.0,
    g: float = 0.1,
    path: str | None = None,
    width: float = 100.0,
    height: float = 100.0,
    guide: str = "model",
) -> DataFrame:
    """The history of a search: random trials first, then rounds that ``next_trials`` proposes.

    Below ``path`` (a fresh folder of the shared ones if not given) each round
    writes its layouts, then its rows of the history in a folder of their own and, as
    it goes, the lines that ``trial_progress`` reads.  A round counts once all of its
    rows are there; a search that was interrupted goes on after the last such round,
    and what a broken round left is written over.
    """
    spark = edges.sparkSession
    path = path or scratch_path(spark, "sweep")
    baseline = None
    for number in range(rounds):
        first = number * per_round
        history = materialize(read_trials(spark, history_path(path)))
        done = history.where(F.col("trial").between(first, first + per_round - 1)).count()
        if done == per_round:
            continue
        trials = next_trials(history, first, per_round, guide, keep, 0.5**number, seed)
        trials = materialize(trials)
        if baseline is None:
            baseline = materialize(random_baseline(vertices.select("id"), edges, r, g))
        lines = Markers(spark, path, number)
        for trial in range(first, first + per_round):
            lines.add(f"##NewIteration:{trial}##")
        lines.write("##LayoutGen##: 0%")
        layouts = force_layouts(vertices, edges, trials, iterations, width, height)
        write_layout(layouts, f"{path}/layouts/round={number}", "parquet", "overwrite")
        layouts = read_layout(spark, f"{path}/layouts/round={number}", "parquet")
        lines.write("##LayoutGen##: 100%", "##ComputeNodeOcclusion##", "##ComputeEdgeCrossing##")
        found = evaluate_trials(
            vertices, edges, trials, baseline, iterations, r, g, layouts=layouts
        )
        write_trials(found, f"{history_path(path)}/round={number}", "overwrite")
        lines.write("##Visualizing##")
    return read_trials(spark, history_path(path))


def history_path(path: str) -> str:
    return f"{path}/history"


def best_layout(spark: SparkSession, path: str) -> DataFrame:
    """``trial, id, x, y`` of the best trial of a search below ``path``."""
    best = best_trial(read_trials(spark, history_path(path))).select("trial")
    layouts = spark.read.parquet(f"{path}/layouts").select("trial", "id", "x", "y")
    return layouts.join(F.broadcast(best), "trial")  # one row
