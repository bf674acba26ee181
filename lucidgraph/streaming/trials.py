"""The trial history as a stream: the state of a search while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trials import TRIALS


def trial_status(trials: DataFrame) -> DataFrame:
    """``trials, best_score, best_trial``: one row, the same on a batch or a stream."""
    # trials without a score never win
    rank = F.when(F.col("score").isNotNull(), F.struct("score", "trial"))
    return trials.agg(
        F.count("*").alias("trials"),
        F.min("score").alias("best_score"),
        F.min_by("trial", rank).alias("best_trial"),
    )


def stream_trials(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Follow the files of a history folder.

    Write it in complete mode: the state is a single row, and without event
    time there is nothing to expire.
    """
    reader = spark.readStream.schema(TRIALS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return trial_status(reader.json(folder))
