"""Stored layouts: JSON rows ``id, pos`` (or Parquet), one folder per trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pos", T.ArrayType(T.DoubleType())),
        T.StructField("trial", T.LongType()),
    ]
)


def with_pos(layout: DataFrame) -> DataFrame:
    return layout.withColumn("pos", F.array("x", "y")).drop("x", "y")


def with_xy(layout: DataFrame) -> DataFrame:
    """Accept the array form of a position as well as x, y columns."""
    if "pos" not in layout.columns:
        return layout
    return layout.withColumns(
        {"x": F.get("pos", F.lit(0)), "y": F.get("pos", F.lit(1))}
    ).drop("pos")


def write_layout(
    layout: DataFrame, path: str, format: str = "json", mode: str = "errorifexists"
) -> None:
    """Persist the layouts, partitioned by trial; an existing path is an error by default."""
    out = with_pos(layout) if format == "json" else layout
    out.write.mode(mode).partitionBy("trial").format(format).save(path)


def read_layout(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    if format == "json":
        stored = with_xy(spark.read.schema(_JSON).json(path))
    else:
        stored = spark.read.format(format).load(path)
    return stored.select(F.col("trial").cast("bigint").alias("trial"), "id", "x", "y")
