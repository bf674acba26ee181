"""Edges joined to their end points, and per-vertex aggregation of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = ("trial",)
# copies of a one-row frame of a layout
_FRAME_PARTS = 64


def zero_filled(layout: DataFrame, counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``by, n``: the counts' ``n`` summed, with a row for every layout, also for those without any."""
    none = layout.select(*by).distinct().withColumn("n", F.lit(0))
    return counts.select(*by, "n").unionByName(none).groupBy(*by).agg(F.sum("n").alias("n"))


def framed(rows: DataFrame, frame: DataFrame, by: Sequence[str], *spread: str) -> DataFrame:
    """``rows`` with the columns of ``frame``, which has one row for each layout.

    The join has a second key, a hash of the ``spread`` columns: a layout with most
    of the rows spreads over tasks, and the keys stay when ``by`` is one constant.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(_FRAME_PARTS - 1)))
    part = F.pmod(F.xxhash64(*spread), F.lit(_FRAME_PARTS)).cast("int")
    return (
        rows.withColumn("_part", part)
        .join(frame.withColumn("_part", parts), [*by, "_part"])
        .drop("_part")
    )


def locate_edges(edges: DataFrame, layout: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Edges with coordinates: ``by, src, dst, x1, y1, x2, y2``.

    An edge whose end point has no position is dropped (see ``dangling_edges``).
    Edges are shared by all layouts, so the first join brings in ``by``.
    """
    by = list(by)
    source = layout.select(
        *by, F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")
    )
    target = layout.select(
        *by, F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return (
        edges.select("src", "dst")
        .join(source, "src")
        .join(target, [*by, "dst"])
        .select(*by, "src", "dst", "x1", "y1", "x2", "y2")
    )


def dangling_edges(
    edges: DataFrame, layout: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Edges with an end point that no layout places; with ``by``, that a layout does not place."""
    by = list(by)
    placed = layout.select(*by, "id").distinct()
    if by:
        groups = layout.select(*by).distinct()
        copies = F.explode(F.sequence(F.lit(0), F.lit(_FRAME_PARTS - 1)))
        part = F.pmod(F.xxhash64("src", "dst"), F.lit(_FRAME_PARTS)).cast("int")
        # every edge is looked for in every layout
        edges = (
            edges.select("src", "dst", part.alias("_part"))
            .join(groups.withColumn("_part", copies), "_part")
            .drop("_part")
        )
    for end in ("src", "dst"):
        there = placed.select(*by, F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
        edges = edges.join(there, [*by, end], "left")
    missing = F.col("has_src").isNull() | F.col("has_dst").isNull()
    return edges.where(missing).select(*by, "src", "dst")


def messages(
    vertices: DataFrame,
    edges: DataFrame,
    to_src: Column | None = None,
    to_dst: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row ``by, id, msg`` per message.

    ``to_src`` and ``to_dst`` are expressions over ``src_<column>`` and
    ``dst_<column>`` for every attribute column of ``vertices``.
    """
    by = list(by)
    attributes = [c for c in vertices.columns if c not in ("id", *by)]

    def end(side: str) -> DataFrame:
        return vertices.select(
            *by,
            F.col("id").alias(side),
            *[F.col(c).alias(f"{side}_{c}") for c in attributes],
        )

    sent = []
    if to_src is not None:
        sent.append(F.struct(F.col("src").alias("id"), to_src.alias("msg")))
    if to_dst is not None:
        sent.append(F.struct(F.col("dst").alias("id"), to_dst.alias("msg")))
    if not sent:
        raise ValueError("give to_src, to_dst or both")
    triplets = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), [*by, "dst"])
    # the triplets are joined once; each row then yields one or two messages
    return triplets.select(*by, F.inline(F.array(*sent)))


def aggregate_messages(
    vertices: DataFrame,
    edges: DataFrame,
    aggs: Sequence[Column],
    to_src: Column | None = None,
    to_dst: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Send a value along each edge and aggregate ``msg`` per receiving vertex.

    A vertex that receives nothing is absent from the result.
    """
    return messages(vertices, edges, to_src, to_dst, by).groupBy(*by, "id").agg(*aggs)
