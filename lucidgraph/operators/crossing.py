"""Edge crossings counted in strips, and the angles they cross at.

In a strip that both edges span, a crosses b from below exactly if it is lower
on the left border and higher on the right one.  Counting is therefore counting
inversions, and no pair is listed; ``crossing_pairs`` lists them on request.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import acute_angle
from ..functions.hinges import deviation_totals, kinks
from ..plans import cells as C
from ..plans import dominance as D
from ..plans.packets import deviations_in_packets, inverted_in_packets
from ..plans.ranks import dense_ranks, in_ranges
from ..session import delete, materialize, scratch_path, shuffles_freed
from .messages import BY, zero_filled
from .strips import cut_into_strips, distinct_lines, strip_segments

# bits of a rank that one running sum of the bitwise plan tells apart
_DIGIT = 3
# strips that are counted together move about so many bytes
BATCH_BYTES = 1 << 31
# what a piece moves to be counted, and to have its angles added up
_COUNT_BYTES, _ANGLE_BYTES = 26, 235


def lines_per_layout(
    lines: DataFrame, edges: DataFrame, by: Sequence[str], max_rows: int = D.MAX_GROUP_ROWS
) -> int:
    """A bound for the lines of any layout, and so of any strip: few edges, or the lines themselves."""
    total = edges.count()
    return total if total <= max_rows else D.largest_group(lines, by)[0]


def _in_batches(
    lines: DataFrame, g: float, key: list[str], piece_bytes: int, count: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """``count(pieces, bound)`` of all strips, where no strip has more than ``bound`` pieces.

    Only so many strips at a time that their pieces move about ``BATCH_BYTES``; what one
    batch has moved is given back before the next.
    """
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "lines")
    # read for the sizes, and for the cuts and the counts of each batch
    with shuffles_freed(spark):
        lines.write.parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    bound, total = D.largest_group(cut_into_strips(lines, g), key)
    batches = max(1, -(-total * piece_bytes // BATCH_BYTES))
    if batches == 1:
        return count(cut_into_strips(lines, g), bound)
    parts = [materialize(count(cut_into_strips(lines, g, i, batches), bound)) for i in range(batches)]
    delete(spark, path)
    return functools.reduce(DataFrame.unionByName, parts)


def edge_crossing_by_strip(
    layout: DataFrame,
    edges: DataFrame,
    g: float = 0.1,
    by: Sequence[str] = BY,
    plan: str = "chunked",
    max_rows: int = D.MAX_GROUP_ROWS,
    chunk_rows: int = D.CHUNK_ROWS,
) -> DataFrame:
    """``by, part, crossings`` for every strip that holds a segment.

    ``plan="chunked"`` counts each strip in one group while strips are small
    and in chunks beyond that; ``plan="bitwise"`` uses window functions only, on
    cuts of a strip, and never leaves the JVM.
    """
    by = list(by)
    lines = distinct_lines(layout, edges, by)
    pieces = cut_into_strips(lines, g)
    if plan == "bitwise":
        return _bitwise(pieces, [*by, "part"])
    if plan != "chunked":
        raise ValueError(f"unknown plan {plan!r}")
    key = [*by, "part"]

    def count(pieces: DataFrame, bound: int) -> DataFrame:
        found = None
        if bound > max_rows:
            found = inverted_in_packets(pieces, key, max_rows, chunk_rows)
        if found is None:
            rows = pieces.select(*key, "ly", "ry", F.col("w").alias("wa"), F.col("w").alias("wb"))
            found = D.inverted_totals(
                rows,
                key,
                ["ly", "ry"],
                ["ry", "ly"],
                row_bound=bound,
                max_rows=max_rows,
                chunk_rows=chunk_rows,
            )
        return found.select(*key, F.col("pairs").alias("crossings"))

    bound = lines_per_layout(lines, edges, by, max_rows)
    if bound <= max_rows:
        return count(pieces, bound)
    return _in_batches(lines, g, key, _COUNT_BYTES, count)


def _bitwise(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Inversions with windows only.

    Rows are cut by ranges of left height, and again by ranges of right height.  Two rows of
    one left cut are compared there, two of one right cut but different left ones there, and
    all others by the cuts alone, of which a strip has few.  So rows move once for each cut,
    whatever the number of bits, and no task sorts a strip.
    """
    # identical pieces do not cross: fold them, so that no tie is left to chance
    folded = pieces.groupBy(*key, "ly", "ry").agg(F.sum("w").alias("w"))
    left = in_ranges(folded, key, ["ly", "ry"], "left_cut")
    both = in_ranges(left, key, ["ry", "ly"], "right_cut")
    cuts = both.groupBy(*key, "left_cut", "right_cut").agg(F.sum("w").alias("w"))
    counts = [
        _inverted_here(left, key, "left_cut", ["ly", "ry"], ["ry", "ly"]),
        _inverted_here(both, key, "right_cut", ["left_cut"], ["ry", "ly"]),
        _inverted_here(cuts, key, None, ["left_cut"], ["right_cut"]),
    ]
    return (
        functools.reduce(DataFrame.unionByName, counts)
        .groupBy(*key)
        .agg(F.sum("n").alias("crossings"))
    )


def _inverted_here(
    rows: DataFrame, key: list[str], cut: str | None, first: list[str], second: list[str]
) -> DataFrame:
    """``key, n``: weighted pairs of rows of equal ``key`` and ``cut`` that ``first`` and
    ``second`` order differently, both strictly.

    The ranks of a pair by ``second`` differ in one highest digit of ``_DIGIT`` bits.  Among rows
    with equal higher digits, taken by ``first``, the pair is inverted if the earlier row has the
    larger digit; a running sum for each digit tells the weight of those.
    """
    group = [*key, cut] if cut else key
    # the windows below all keep to this partitioning, so the levels never move; a number of
    # tasks that adaptive execution keeps, as each of these rows becomes one for each level
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = rows.repartition(tasks, *group)
    # ties by ``first`` are laid out by ``second``, and so never look inverted
    ranked = here.select(
        *group,
        "w",
        (F.row_number().over(Window.partitionBy(*group).orderBy(*dict.fromkeys([*first, *second]))) - 1).alias("place"),
        (F.dense_rank().over(Window.partitionBy(*group).orderBy(*second)) - 1).cast("bigint").alias("rank"),
    )
    top = F.max("rank").over(Window.partitionBy(*group))
    last = F.floor((F.length(F.bin(top)) - 1) / _DIGIT).cast("int")
    levels = ranked.withColumn("last", last).select(
        *group, "w", "place", "rank", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("level")
    ).select(
        *group,
        "w",
        "place",
        "level",
        F.expr(f"shiftright(rank, {_DIGIT} * (level + 1))").alias("prefix"),
        F.expr(f"shiftright(rank, {_DIGIT} * level) & {2**_DIGIT - 1}").alias("digit"),
    )
    before = (
        Window.partitionBy(*group, "level", "prefix")
        .orderBy("place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # for each digit the weight of the earlier rows with a larger one
    ahead = [
        F.sum(F.when(F.col("digit") > digit, F.col("w")).otherwise(0)).over(before).alias(f"_{digit}")
        for digit in range(2**_DIGIT - 1)
    ]
    above = F.coalesce(F.get(F.array(*[f"_{d}" for d in range(2**_DIGIT - 1)]), F.col("digit").cast("int")), F.lit(0))
    return (
        levels.select(*key, "w", "digit", *ahead)
        .select(*key, (F.col("w") * above).alias("n"))
        .groupBy(*key)
        .agg(F.sum("n").alias("n"))
    )


def edge_crossing_strips(
    layout: DataFrame, edges: DataFrame, g: float = 0.1, by: Sequence[str] = BY, **plan
) -> DataFrame:
    """``by, edge_crossing``; 0 when no edge spans a strip.

    Crossings in the partial pieces at the edge ends are missed, so this is a
    lower bound that approaches the exact count as g shrinks.
    """
    counts = (
        edge_crossing_by_strip(layout, edges, g, by, **plan)
        .groupBy(*by)
        .agg(F.sum("crossings").alias("n"))
    )
    return zero_filled(layout, counts, by).select(
        *by, F.col("n").cast("bigint").alias("edge_crossing")
    )


def crossing_pairs(
    layout: DataFrame, edges: DataFrame, g: float = 1.0, by: Sequence[str] = BY
) -> DataFrame:
    """The crossing pairs with their acute angle: a starts below b and ends above.

    Segments are points (ly, ry) and a crossing is a dominance between two of
    them.  Equal segments are one point until the rows go out, and cells lie on
    the ranks of the heights, so that ties end at the last level.  Pairs of cells
    are split until they are small: rows spread evenly and few pairs are met that
    do not cross.  A point of one segment carries its edge, so its pairs go out where
    they are found; only those of several segments move once more.
    """
    by = list(by)
    key = [*by, "part"]
    pieces = materialize(strip_segments(layout, edges, g, by))
    edge = ("src", "dst", "theta")
    points = pieces.groupBy(*key, "ly", "ry").agg(
        F.count("*").alias("w"), *[F.min(c).alias(c) for c in edge]
    )
    for height, rank in (("ly", "u"), ("ry", "v")):
        points = dense_ranks(points, key, height, rank)
    points = materialize(points)
    most = points.agg(F.coalesce(F.max(F.greatest("u", "v")), F.lit(0))).head()[0]
    depth = most.bit_length()
    size = F.lit(2.0**-depth)
    points = points.withColumns({"u": F.col("u") * size, "v": F.col("v") * size})

    def classify(level: int):
        px, py, qx, qy = (F.col(c) for c in ("px", "py", "qx", "qy"))
        before, after = (px < qx) & (py > qy), (px > qx) | (py < qy)
        # a cell of the last level is one height: equal ones do not cross
        return before, (px >= qx) | (py <= qy) if level == depth else after

    start = C.neighbour_pairs(C.cell_sizes(points, 0, key), [(0, 0)], key)
    met = functools.reduce(
        DataFrame.unionByName,
        [
            C.point_pairs(points, direct, level, key)
            .where((F.col("p_ly") < F.col("q_ly")) & (F.col("p_ry") > F.col("q_ry")))
            .select(*key, *[f"{side}_{c}" for side in "pq" for c in ("ly", "ry", "w", *edge)])
            for level, _, direct in C.refine(
                points, key, start, classify, False, True, depth, few=C.few_listed
            )
        ],
    )
    single = (F.col("p_w") == 1) & (F.col("q_w") == 1)
    out = [*key, *[f"{side}_{c}" for side in "pq" for c in edge]]
    found = met.where(single).select(*out)
    if not points.where("w > 1").isEmpty():

        def named(name: str) -> DataFrame:
            return pieces.select(
                *key, *[F.col(c).alias(f"{name}_{c}") for c in ("ly", "ry", *edge)]
            )

        several = met.where(~single).select(*key, "p_ly", "p_ry", "q_ly", "q_ry")
        several = several.join(named("p"), [*key, "p_ly", "p_ry"])
        found = found.unionByName(several.join(named("q"), [*key, "q_ly", "q_ry"]).select(*out))
    return found.select(
        *key,
        F.col("p_src").alias("a_src"),
        F.col("p_dst").alias("a_dst"),
        F.col("q_src").alias("b_src"),
        F.col("q_dst").alias("b_dst"),
        acute_angle(F.col("p_theta"), F.col("q_theta")).alias("theta"),
    )


def edge_crossing_angle(
    layout: DataFrame,
    edges: DataFrame,
    ideal: float = 70.0,
    g: float = 1.0,
    by: Sequence[str] = BY,
    max_rows: int = D.MAX_GROUP_ROWS,
    chunk_rows: int = D.CHUNK_ROWS,
) -> DataFrame:
    """Mean deviation of the crossing angles from ``ideal`` degrees, over ideal.

    0 is best; null when nothing crosses.
    """
    if not 0 < ideal <= 90:
        raise ValueError("ideal must be in (0, 90] degrees")
    by = list(by)
    key = [*by, "part"]
    aim = math.radians(ideal)
    lines = distinct_lines(layout, edges, by)

    def total(pieces: DataFrame, bound: int) -> DataFrame:
        if bound <= max_rows:
            return _angles_per_strip(pieces, key, aim)
        totals = deviations_in_packets(pieces, key, aim, max_rows, chunk_rows)
        if totals is None:  # too many share a height
            totals = _angles_in_chunks(pieces, key, aim, max_rows, chunk_rows)
        return totals

    bound = lines_per_layout(lines, edges, by, max_rows)
    if bound <= max_rows:
        totals = total(cut_into_strips(lines, g), bound)
    else:
        totals = _in_batches(lines, g, key, _ANGLE_BYTES, total)
    none = layout.select(*by).distinct().withColumns(
        {"crossings": F.lit(0), "deviation": F.lit(0.0)}
    )
    sums = (
        totals.select(*by, "crossings", "deviation")
        .unionByName(none)
        .groupBy(*by)
        .agg(F.sum("crossings").alias("n"), F.sum("deviation").alias("d"))
    )
    ratio = F.try_divide(F.col("d"), F.col("n") * F.lit(aim))
    return sums.select(*by, ratio.alias("edge_crossing_angle"))


def _angles_per_strip(pieces: DataFrame, key: list[str], aim: float) -> DataFrame:
    names = [*key, "crossings", "deviation"]

    def measure(
        group_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        held = D.columns_of(batches, ("theta", "ly", "ry", "w"))
        order = np.argsort(held["theta"], kind="stable").astype(np.int32)
        # each column goes as soon as it is sorted
        theta, ly, ry, w = (held.pop(c)[order] for c in ("theta", "ly", "ry", "w"))
        del order
        yield from D.one_row(group_key, names, deviation_totals(ly, ry, theta, w, aim)).to_batches()

    schema = f"{D.key_fields(pieces, key)}, crossings bigint, deviation double"
    return pieces.groupBy(*key).applyInArrow(measure, schema)


def _angles_in_chunks(pieces, key, aim, max_rows, chunk_rows) -> DataFrame:
    """The same sums for strips too large for a task: every term of
    ``functions.hinges`` becomes rows of one inversion count."""
    zero, w, theta = F.lit(0).cast("bigint"), F.col("w"), F.col("theta")
    # per segment the roles it plays: (term, factor, point or query, orders)
    steep_term = [
        (i, side, factor, kink)
        for i, (factor, kink) in enumerate(kinks(aim))
        for side in ("all", "left", "right")
    ]
    roles = [
        F.struct(
            F.lit(0).alias("term"),
            F.col("ly").alias("f1"),
            F.col("ry").alias("f2"),
            F.col("ry").alias("s1"),
            F.col("ly").alias("s2"),
            w.alias("wa"),
            w.alias("wb"),
            (w * theta).alias("sa"),
            (w * theta).alias("sb"),
        )
    ]
    for number, (_, side, _, kink) in enumerate(steep_term, start=1):
        along = {"all": F.lit(0.0), "left": -F.col("ly"), "right": F.col("ry")}[side]
        for query in (0.0, 1.0):
            height = theta + F.lit(kink) if query else theta
            useful = theta < math.pi / 2 - kink if query else theta > kink - math.pi / 2
            weight, total = w, w * height
            roles.append(
                F.when(
                    useful,
                    F.struct(
                        F.lit(number).alias("term"),
                        along.alias("f1"),
                        F.lit(query).alias("f2"),
                        height.alias("s1"),
                        F.lit(query).alias("s2"),
                        (zero if query else weight).alias("wa"),
                        (weight if query else zero).alias("wb"),
                        (F.lit(0.0) if query else total).alias("sa"),
                        (total if query else F.lit(0.0)).alias("sb"),
                    ),
                )
            )
    rows = pieces.select(*key, F.inline(F.array_compact(F.array(*roles))))
    totals = D.inverted_totals(
        rows,
        [*key, "term"],
        ["f1", "f2"],
        ["s1", "s2"],
        sums=True,
        max_rows=max_rows,
        chunk_rows=chunk_rows,
    )
    difference = F.col("sum_a") - F.col("sum_b")
    crossing = F.col("term") == 0
    share = F.when(crossing, F.lit(aim) * F.col("pairs") - difference)
    for number, (_, side, factor, _) in enumerate(steep_term, start=1):
        sign = factor if side == "all" else -factor
        share = share.when(F.col("term") == number, F.lit(sign) * difference)
    return totals.groupBy(*key).agg(
        F.sum(F.when(crossing, F.col("pairs")).otherwise(0)).alias("crossings"),
        F.sum(share).alias("deviation"),
    )
