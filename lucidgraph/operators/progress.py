"""What a running search is doing, from the lines it prints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the markers in the printed lines and the stage each one starts
STAGES = {
    "NewIteration": "preparing",
    "LayoutGen": "layout",
    "ComputeNodeOcclusion": "node occlusion",
    "ComputeEdgeCrossing": "edge crossing",
    "Visualizing": "drawing",
}


# lines that one round may print; their numbers follow those of the round before
_ROUND_LINES = 1 << 32
_LOG = "line_no bigint, line string"


class Markers:
    """The lines of one round of a search, appended to its log as stages begin."""

    def __init__(self, spark: SparkSession, path: str, number: int):
        self.spark, self.path = spark, f"{path}/progress"
        self.at, self.waiting = number * _ROUND_LINES, []

    def add(self, *lines: str) -> None:
        for line in lines:
            self.waiting.append((self.at, line))
            self.at += 1

    def write(self, *lines: str) -> None:
        self.add(*lines)
        rows = self.spark.createDataFrame(self.waiting, _LOG)
        rows.coalesce(1).write.mode("append").json(self.path)
        self.waiting = []


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` that a search has written so far."""
    return spark.read.schema(_LOG).json(f"{path}/progress")


def trial_progress(
    log: DataFrame, total: int = 50, by: Sequence[str] = ()
) -> DataFrame:
    """``by, trial, stage, percent, layout_percent`` from ``line_no, line``.

    The latest marker tells the stage; percent is how many of ``total`` trials
    have begun before this one.
    """
    names = "|".join(STAGES)
    marker = F.regexp_extract("line", rf"##({names})(?::\d+)?##", 1)
    number = F.regexp_extract("line", r"##NewIteration:(\d+)##", 1)
    done = F.regexp_extract("line", r"##LayoutGen##:\s*(\d+)%", 1)
    lines = log.select(
        *by,
        "line_no",
        marker.alias("marker"),
        F.when(number != "", number).cast("bigint").alias("number"),
        F.when(done != "", done).cast("int").alias("done"),
    ).where(F.col("marker") != "")
    stage = F.lit(None).cast("string")
    for name, label in STAGES.items():
        stage = F.when(F.col("marker") == name, label).otherwise(stage)
    begun = F.when(F.col("number").isNotNull(), F.col("line_no"))
    shown = F.when(F.col("done").isNotNull(), F.col("line_no"))
    # each is a partial aggregate; a log of any length leaves one row per task
    return (
        lines.groupBy(*by)
        .agg(
            F.max_by("number", begun).alias("trial"),
            F.max_by(stage, F.col("line_no")).alias("stage"),
            F.max(begun).alias("begun"),
            F.max(shown).alias("shown"),
            F.max_by("done", shown).alias("done"),
        )
        .select(
            *by,
            "trial",
            "stage",
            F.floor(F.lit(100.0) * F.col("trial") / F.lit(float(total))).cast("int").alias("percent"),
            # of the current trial only
            F.when(F.col("shown") > F.col("begun"), F.col("done")).alias("layout_percent"),
        )
    )
