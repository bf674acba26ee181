"""The trial history: one JSON row per evaluated layout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TRIALS = T.StructType(
    [
        T.StructField("trial", T.LongType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("nc", T.LongType()),
        T.StructField("nc_t", T.DoubleType()),
        T.StructField("ec", T.LongType()),
        T.StructField("ec_t", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def write_trials(trials: DataFrame, path: str, mode: str = "append") -> None:
    """Append a round of trials as a new set of files, or write it over the last attempt."""
    trials.select(*TRIALS.fieldNames()).write.mode(mode).json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The history so far; empty when nothing has been written yet."""
    try:
        # the folders of single rounds would add a column
        return spark.read.schema(TRIALS).json(path).select(*TRIALS.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TRIALS)
