"""Connected components of links between documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every end of ``links`` (u, v): the smallest end that it reaches.

    Each round hangs every node's larger, then smaller neighbours on its smallest
    one; the rounds grow with the logarithm of the nodes.  Rows are stored
    between rounds, and nothing but counts comes to the driver.
    """
    edges = stored(
        links.where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct(),
        "edges",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select("v", "m").union(joined.select("u", "m")).toDF("u", "v")
        edges = stored(small.where("u != v").distinct(), "edges")
    roots = edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("v"), F.col("v"))).distinct()
