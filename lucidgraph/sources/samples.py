"""Graphs that the given tables hold, each from its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import edges_from_table


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customer - supplier: who bought from whom."""
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return edges_from_table(joined, _key("c", "o_custkey"), _key("s", "l_suppkey"))


def purchase_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Order - customer: many small stars, most vertices of degree one."""
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return edges_from_table(orders, _key("o", "o_orderkey"), _key("c", "o_custkey"))


def geography_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customer - nation, supplier - nation, nation - region: a tree with hubs."""
    levels = [
        ("customer", _key("c", "c_custkey"), _key("n", "c_nationkey")),
        ("supplier", _key("s", "s_suppkey"), _key("n", "s_nationkey")),
        ("nation", _key("n", "n_nationkey"), _key("r", "n_regionkey")),
    ]
    parts = [
        edges_from_table(_table(spark, folder, name), src, dst) for name, src, dst in levels
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
