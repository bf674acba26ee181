"""Points in square cells, and pairs of cells refined level by level.

Both pairwise operators (who overlaps whom, who repels whom) ask the same
question about two groups of points: can it be answered for the groups as a
whole, or must they be split?  A level has cells of half the side of the level
above, so a crowded cell is split until its pairs are few, and no step ever
lists the pairs of an unbounded group.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# two cells are compared point by point once the product of their sizes is this low
PAIR_BUDGET = 16_384
# the same where the pairs are listed: of n pairs, about n / sqrt(LIST_BUDGET) rows move
LIST_BUDGET = 4_194_304
# rows of both cells of a pair that one task may compare with a kernel
KERNEL_ROWS = 1_000_000
# rows that move at a time to be compared with a kernel, and pairs of cells that are broadcast
MOVED_ROWS = 30_000_000
SMALL_PAIRS = 100_000
# at this level a cell of coordinates from 1/2 on holds one double; what is unsettled
# there is closer than 2^-60 cell sides to its neighbours
MAX_LEVEL = 60


def at_level(points: DataFrame, level: int) -> DataFrame:
    """Adds ``cx, cy``: the cell of (u, v) at ``level``.

    Scaling by a power of two is exact, so the cells of one level nest in the
    cells of the level above.
    """
    scale = F.lit(float(2**level))
    return points.withColumns(
        {
            "cx": F.floor(F.col("u") * scale).cast("bigint"),
            "cy": F.floor(F.col("v") * scale).cast("bigint"),
        }
    )


def cell_sizes(points: DataFrame, level: int, by: Sequence[str]) -> DataFrame:
    """``by, cx, cy, points, w``: distinct points and their total weight per cell."""
    return (
        at_level(points, level)
        .groupBy(*by, "cx", "cy")
        .agg(F.count("*").alias("points"), F.sum("w").alias("w"))
    )


def _side(cells: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return cells.select(
        *by,
        F.col("cx").alias(f"{name}x"),
        F.col("cy").alias(f"{name}y"),
        F.col("points").alias(f"{name}_points"),
        F.col("w").alias(f"{name}_w"),
    )


def neighbour_pairs(cells: DataFrame, offsets, by: Sequence[str]) -> DataFrame:
    """Pairs of occupied cells (p, q) with q - p in ``offsets``."""
    by = list(by)
    # as one text: a call for each of many literals takes longer than the join
    structs = ", ".join(f"named_struct('dx', {dx}, 'dy', {dy})" for dx, dy in offsets)
    wanted = F.expr(f"inline(array({structs}))")
    shifted = (
        _side(cells, by, "p")
        .select("*", wanted)
        .withColumns({"qx": F.col("px") + F.col("dx"), "qy": F.col("py") + F.col("dy")})
        .drop("dx", "dy")
    )
    return shifted.join(_side(cells, by, "q"), [*by, "qx", "qy"])


def largest_cell(cells: DataFrame) -> int:
    """Points in the fullest cell: one small job, one number."""
    return cells.agg(F.coalesce(F.max("points"), F.lit(0))).head()[0]


def nearby_points(points: DataFrame, offsets, by: Sequence[str]) -> DataFrame:
    """Pairs of points (p, q) of level-0 cells with q - p in ``offsets``.

    One equi-join on the cell; only for cells known to hold few points.
    """
    by = list(by)
    carried = [c for c in points.columns if c not in by]
    placed = at_level(points, 0)

    def side(name: str) -> DataFrame:
        return placed.select(
            *by,
            F.col("cx").alias(f"{name}x"),
            F.col("cy").alias(f"{name}y"),
            *[F.col(c).alias(f"{name}_{c}") for c in carried],
        )

    wanted = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    shifted = (
        side("p")
        .select("*", F.inline(wanted))
        .withColumns({"qx": F.col("px") + F.col("dx"), "qy": F.col("py") + F.col("dy")})
        .drop("dx", "dy")
    )
    # a row here stands for many pairs: shuffle by cell rather than broadcast, so
    # that the comparisons spread over all tasks even when the bytes are few
    return shifted.join(side("q").hint("merge"), [*by, "qx", "qy"])


def split_pairs(pairs: DataFrame, cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each pair replaced by the (at most 16) pairs of its children.

    ``cells`` is the next level.  A cell has at most four children, so the
    joins multiply a row by a constant, whatever the number of points.
    """
    by = list(by)

    def children(name: str) -> DataFrame:
        side = _side(cells, by, f"{name}c")
        return side.withColumns(
            {
                f"{name}x": F.shiftright(f"{name}cx", 1),
                f"{name}y": F.shiftright(f"{name}cy", 1),
            }
        )

    out = pairs.select(*by, "px", "py", "qx", "qy")
    for name in ("p", "q"):
        out = out.join(children(name), [*by, f"{name}x", f"{name}y"])
    return out.select(
        *by,
        *[
            F.col(f"{name}c{field}").alias(f"{name}{field}")
            for name in ("p", "q")
            for field in ("x", "y", "_points", "_w")
        ],
    )


def few_pairs() -> Column:
    return F.col("p_points") * F.col("q_points") <= PAIR_BUDGET


def few_listed() -> Column:
    """Pairs that a task can compare one by one."""
    return F.col("p_points") * F.col("q_points") <= LIST_BUDGET


def few_rows() -> Column:
    """Pairs that are few, or whose rows a task can hold."""
    return few_pairs() | (F.col("p_points") + F.col("q_points") <= KERNEL_ROWS)


def point_pairs(
    points: DataFrame, pairs: DataFrame, level: int, by: Sequence[str]
) -> DataFrame:
    """The points of both cells of each pair, as ``p_*`` and ``q_*`` columns.

    Only for pairs within the budget, so a row of ``pairs`` yields at most
    ``PAIR_BUDGET`` rows, or ``LIST_BUDGET`` where they are listed.
    """
    by = list(by)
    carried = [c for c in points.columns if c not in by]

    def side(name: str) -> DataFrame:
        return at_level(points, level).select(
            *by,
            F.col("cx").alias(f"{name}x"),
            F.col("cy").alias(f"{name}y"),
            *[F.col(c).alias(f"{name}_{c}") for c in carried],
        )

    return (
        pairs.select(*by, "px", "py", "qx", "qy")
        .join(side("p").hint("merge"), [*by, "px", "py"])
        .join(side("q").hint("merge"), [*by, "qx", "qy"])
    )


def measured_pairs(
    points: DataFrame,
    pairs: DataFrame,
    level: int,
    by: Sequence[str],
    measure: Callable[[tuple, tuple | None], int],
    name: str,
) -> DataFrame:
    """``by, px, py, qx, qy, name``: ``measure`` of the points (x, y, w) of both cells of each pair,
    with None for the second if the cell is paired with itself.

    Rows of points move, never pairs of them, and ``MOVED_ROWS`` of them at a time: what a
    point moves to grows with the cells around its own.  Only for pairs within ``KERNEL_ROWS``.
    """
    by = list(by)
    key = [*by, "px", "py", "qx", "qy"]
    number, moved = pairs.agg(
        F.count("*"), F.coalesce(F.sum(F.col("p_points") + F.col("q_points")), F.lit(0))
    ).head()
    batches = max(1, -(-moved // MOVED_ROWS))
    few = number <= SMALL_PAIRS * batches

    def some(batch: int) -> DataFrame:
        wanted = pairs.where(F.pmod(F.xxhash64(*key), F.lit(batches)) == batch) if batches > 1 else pairs
        return _measured(points, wanted.select(*key), level, by, measure, name, few)

    if batches == 1:
        return some(0)
    return functools.reduce(DataFrame.unionByName, [materialize(some(i)) for i in range(batches)])


def _measured(points, pairs: DataFrame, level: int, by: list[str], measure: Callable, name: str, few: bool) -> DataFrame:
    key = [*by, "px", "py", "qx", "qy"]
    placed = at_level(points, level)
    same = (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))

    def side(first: str, wanted: DataFrame) -> DataFrame:
        cell = [F.col(c).alias(f"{first}{c[1]}") for c in ("cx", "cy")]
        # points of few cells go to them without moving to be joined
        found = (F.broadcast(wanted) if few else wanted).join(placed.select(*by, *cell, "x", "y", "w"), [*by, f"{first}x", f"{first}y"])
        return found.select(*key, F.lit(first == "p").alias("of_p"), "x", "y", "w")

    rows = side("p", pairs).unionByName(side("q", pairs.where(~same)))
    # few bytes can be much work: a number of tasks that adaptive execution keeps
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*key, name]

    def measured(group, table):
        of_p = table.column("of_p").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("x", "y", "w")]
        second = None if of_p.all() else tuple(c[~of_p] for c in columns)
        found = measure(tuple(c[of_p] for c in columns), second)
        arrays = [pa.array([k.as_py()], type=k.type) for k in group] + [pa.array([found])]
        return pa.Table.from_arrays(arrays, names=names)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.repartition(tasks, *key).groupBy(*key).applyInArrow(measured, f"{fields}, {name} bigint")


def refine(
    points: DataFrame,
    by: Sequence[str],
    pairs: DataFrame,
    classify: Callable[[int], tuple[Column, Column]],
    whole: bool,
    ordered: bool,
    max_level: int = MAX_LEVEL,
    start: int = 0,
    few: Callable[[], Column] = few_pairs,
) -> Iterator[tuple[int, DataFrame | None, DataFrame]]:
    """Work off pairs of cells level by level, starting from ``pairs`` at level ``start``.

    ``classify(level)`` gives two conditions on a pair: every pair of points
    belongs to the result, or none does.  Yields (level, pairs of cells taken
    as a whole, pairs of cells whose points are to be compared).  With ``whole=False`` nothing is taken as
    a whole: pairs are split until they are small, so that the point pairs
    spread evenly.  With ``ordered=False`` (p, q) and (q, p) are one pair.  Pairs
    are split until they are ``few``.
    Only tables of cells are written between levels, never of point pairs.
    """
    by = list(by)
    for level in range(start, max_level + 1):
        pairs = materialize(pairs)
        every, none = classify(level)
        settled = every if whole else F.lit(False)
        unsettled = pairs.where(~settled & ~none)
        last = level == max_level
        direct = unsettled if last else unsettled.where(few())
        yield level, pairs.where(settled) if whole else None, direct
        rest = unsettled.where(~few())
        if last or rest.isEmpty():
            return
        pairs = split_pairs(rest, cell_sizes(points, level + 1, by), by)
        if not ordered:
            # a cell paired with itself yields each pair of its quarters twice
            one_parent = (F.shiftright("px", 1) == F.shiftright("qx", 1)) & (
                F.shiftright("py", 1) == F.shiftright("qy", 1)
            )
            pairs = pairs.where(~one_parent | (F.struct("px", "py") <= F.struct("qx", "qy")))
