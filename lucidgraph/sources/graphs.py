"""Edge lists in, vertex sets out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Text, one edge per line: the first two tokens are ``src`` and ``dst``.

    Lines with fewer than two tokens are dropped, further tokens are ignored.
    """
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return (
        spark.read.text(path)
        .select(tokens.alias("tokens"))
        .where(F.size("tokens") >= 2)
        .select(F.col("tokens")[0].alias("src"), F.col("tokens")[1].alias("dst"))
    )


def edges_from_table(df: DataFrame, src, dst) -> DataFrame:
    """Distinct edges from two columns of any table; rows with a null end are dropped."""
    src = F.col(src) if isinstance(src, str) else src
    dst = F.col(dst) if isinstance(dst, str) else dst
    return (
        df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .distinct()
    )


def vertices_of(edges: DataFrame) -> DataFrame:
    """Every end point once, as ``id``."""
    # one pass over the edges instead of a union of two scans
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
