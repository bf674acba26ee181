"""Proposals for the next trials from a model of all trials so far.

A Gaussian process is fitted to the scores of a study, and the points of largest expected
improvement over its best score are proposed.  The history is a table: studies are
fitted side by side, each in one task, on a bounded number of its trials.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import unit_hash

# searched ranges
C_RANGE = (1.0, 20.0)
T_RANGE = (0.1, 100.0)
#: Trials of a study that a model is fitted to: half of them the best, half the latest.
OBSERVATIONS = 1000
#: Length scales to choose from, in units of the ranges, and the variance of noise.
LENGTHS = (0.1, 0.2, 0.4, 0.8)
NOISE = 1e-4
#: Points near the best trial, a quarter of the others in number, lie within this of it.
LOCAL_RADIUS = 0.1

_erfc = np.vectorize(math.erfc, otypes=[float])


def matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Matern 5/2 covariances of the points of two tables."""
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) * (math.sqrt(5.0) / length)
    return (1.0 + d + d * d / 3.0) * np.exp(-d)


class Process:
    """A Gaussian process through (points, values), values with mean 0 and variance 1."""

    def __init__(self, points: np.ndarray, values: np.ndarray, length: float):
        self.points, self.values, self.length = points, values, length
        covariance = matern(points, points, length) + NOISE * np.eye(len(points))
        self.factor = np.linalg.cholesky(covariance)
        self.solved = np.linalg.solve(self.factor, values)

    def log_likelihood(self) -> float:
        return -0.5 * self.solved @ self.solved - np.log(np.diag(self.factor)).sum()

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(means, standard deviations) of the values at some points."""
        across = np.linalg.solve(self.factor, matern(self.points, at, self.length))
        variance = 1.0 - (across * across).sum(axis=0)
        return across.T @ self.solved, np.sqrt(np.maximum(variance, 1e-12))


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """How far below ``best`` a value will be on average, counting what is not below as 0."""
    z = (best - mean) / deviation
    return deviation * (
        z * 0.5 * _erfc(-z / math.sqrt(2.0)) + np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    )


def fitted(points: np.ndarray, values: np.ndarray) -> Process:
    """The process with the likeliest of ``LENGTHS``, the shortest of equals."""
    return max((Process(points, values, x) for x in LENGTHS), key=Process.log_likelihood)


def propose(points: np.ndarray, scores: np.ndarray, candidates: np.ndarray, count: int):
    """(points, expected improvements) of the next ``count`` trials in the unit square.

    After each one the model takes its mean there for its score, so that the trials
    of a round spread.
    """
    spread = scores.std() or 1.0
    values = (scores - scores.mean()) / spread
    centre = points[np.argmin(values)]
    near = centre + (candidates[: len(candidates) // 4] - 0.5) * (2.0 * LOCAL_RADIUS)
    candidates = np.concatenate([candidates, np.clip(near, 0.0, 1.0)])
    model = fitted(points, values)
    chosen, gains = [], []
    for _ in range(count):
        mean, deviation = model.predict(candidates)
        gain = expected_improvement(mean, deviation, values.min())
        at = int(np.argmax(gain))
        chosen.append(candidates[at])
        gains.append(gain[at] * spread)
        points = np.concatenate([points, candidates[at : at + 1]])
        values = np.append(values, mean[at])
        model = Process(points, values, model.length)
    return np.array(chosen), np.array(gains)


def _observed(history: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The trials of each study that its model sees."""
    rows = history.where(F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.select(*by, "trial", "c", "t", "score")
    half = max(1, limit // 2)

    def first(*order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_place", place).where(F.col("_place") <= half).drop("_place")

    return first("score", "trial").union(first(F.desc("trial"), "score")).distinct()


def proposed_trials(
    history: DataFrame,
    count: int = 1,
    by: Sequence[str] = (),
    candidates: int = 512,
    seed: int = 42,
    observations: int = OBSERVATIONS,
) -> DataFrame:
    """``by, place, c, t, expected_improvement``: the next ``count`` trials of every study.

    ``history`` has ``trial, c, t, score`` (lower is better; rows without a score are
    left out, and so are studies without any).  The points to choose from are
    ``candidates`` of the searched ranges and a quarter as many near the best trial.
    """
    by, spark = list(by), history.sparkSession
    points = spark.range(candidates).select(
        unit_hash(F.col("id"), seed).alias("u"), unit_hash(F.col("id"), seed + 1).alias("v"), "id"
    )
    square = np.array([(r.u, r.v) for r in points.orderBy("id").collect()])
    low = np.array([C_RANGE[0], T_RANGE[0]])
    width = np.array([C_RANGE[1], T_RANGE[1]]) - low
    names = ["place", "c", "t", "expected_improvement"]

    def next_trials(key, trials):
        seen = np.stack([trials.column(c).to_numpy() for c in ("c", "t")], axis=1)
        scores, order = trials.column("score").to_numpy(), trials.column("trial").to_numpy()
        order = np.lexsort((scores, order))
        chosen, gains = propose((seen[order] - low) / width, scores[order], square, count)
        chosen = low + chosen * width
        columns = [pa.array(np.arange(count), pa.int32()), *map(pa.array, (*chosen.T, gains))]
        columns = [pa.array([k.as_py()] * count, k.type) for k in key] + columns
        return pa.Table.from_arrays(columns, names=[*by, *names])

    kinds = "".join(f"`{c}` {history.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}place int, c double, t double, expected_improvement double"
    seen = _observed(history, by, observations)
    if by:
        return seen.groupBy(*by).applyInArrow(next_trials, schema)
    grouped = seen.groupBy(F.lit(0).alias("_study"))
    return grouped.applyInArrow(lambda key, rows: next_trials((), rows), schema)
