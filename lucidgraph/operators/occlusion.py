"""Node occlusion: pairs of vertices closer than 2r.

Counting takes whole cells wherever it can, so a crowd of any density costs far
less than its pairs; ``occluded_pairs`` lists them, coincident vertices folded
until the rows go out.
"""

from __future__ import annotations

import functools
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.closeness import close_pairs
from ..functions.geometry import floor_div, squared_distance, unit_hash
from ..functions.sketch import pair_registers
from ..plans import cells as C
from ..plans import dominance as D
from ..session import materialize, stored
from .messages import BY, framed, zero_filled

# pairs of vertices in disc cells of a layout that are listed to be sketched
LISTED_PAIRS = 4_194_304
# a cell and half of its ring, so that each pair of cells comes up once
_HALF_RING = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]


def _close(r: float) -> Column:
    """Points p and q are strictly closer than 2r."""
    limit = F.lit(float(2 * r)) * F.lit(float(2 * r))
    return squared_distance(*[F.col(c) for c in ("p_x", "p_y", "q_x", "q_y")]) < limit


def _once(earlier: Column) -> Column:
    """Inside a cell paired with itself, keep each pair of points once."""
    same_cell = (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))
    return ~same_cell | earlier


def _scaled(points: DataFrame, r: float) -> DataFrame:
    side = F.lit(float(2 * r))
    return points.withColumns({"u": F.col("x") / side, "v": F.col("y") / side})


def _cell_distance(level: int) -> tuple[Column, Column]:
    """(all pairs of two cells are closer than 2r, none are).

    In cell sides of level 0 as doubles, and not decided near the boundary, so
    that neither rounding nor the depth of the level can matter.
    """
    side = F.lit(2.0**-level)
    far = F.lit(2 << level)  # more than that is out of reach and could overflow
    dx, dy = (
        F.least(F.abs(F.col(p) - F.col(q)), far) for p, q in (("px", "qx"), ("py", "qy"))
    )

    def squares(shift: int) -> Column:
        x, y = (F.greatest(d + shift, F.lit(0)).cast("double") * side for d in (dx, dy))
        return x * x + y * y

    return squares(1) < F.lit(1 - 1e-12), squares(-1) > F.lit(1 + 1e-12)


def _refine(
    points: DataFrame,
    by: list[str],
    whole: bool,
    only: Column | None = None,
    few: Callable[[], Column] = C.few_pairs,
) -> Iterator[tuple]:
    """``cells.refine`` from neighbouring cells of side 2r.  Yields (level, settled pairs of
    cells, pairs of cells to compare, pairs of their points); without pairs of cells, and
    with a single join, if no cell is crowded.

    ``only`` is a condition on the first cell (px, py) of a pair.
    """
    some = F.lit(True) if only is None else only
    sizes = C.cell_sizes(points, 0, by)
    budget = C.LIST_BUDGET if few is C.few_listed else C.PAIR_BUDGET
    if C.largest_cell(sizes) ** 2 <= budget:
        yield 0, None, None, C.nearby_points(points, _HALF_RING, by).where(some)
        return
    pairs = C.neighbour_pairs(sizes, _HALF_RING, by).where(some)
    plan = C.refine(points, by, pairs, _cell_distance, whole, False, few=few)
    for level, settled, direct in plan:
        small = direct.where(C.few_pairs()) if few is C.few_rows else direct
        yield level, settled, direct, C.point_pairs(points, small, level, by)


def _first_cell(level: int, x: str = "px", y: str = "py") -> list[Column]:
    """The cell of level 0 that holds a cell of ``level``."""
    return [F.shiftright(c, level).alias(name) for c, name in ((x, "home_x"), (y, "home_y"))]


def _close_counts(
    spots: DataFrame, r: float, by: list[str], only: Column | None = None
) -> DataFrame:
    """``by, home_x, home_y, n``: rows whose n add up to the pairs closer than 2r of
    weighted ``spots``, each with the cell of side 2r that the pair belongs to.

    Pairs of cells count as a whole or, while small, point by point in a join; up to
    ``KERNEL_ROWS`` rows meet in one task, and larger pairs are split.
    """
    # a spot with itself, as a pair of equal cells
    own = C.at_level(spots, 0).select(
        *by, F.col("cx").alias("px"), F.col("cy").alias("py"), F.expr("w * (w - 1) div 2").alias("n")
    )
    own = own if only is None else own.where(only)
    parts = [own.select(*by, *_first_cell(0), "n")]
    same_cell = (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy"))
    x1, y1, x2, y2 = (F.col(c) for c in ("p_x", "p_y", "q_x", "q_y"))
    spot_order = _once((x1 < x2) | ((x1 == x2) & (y1 < y2)))
    limit = float(2 * r) * float(2 * r)

    def measure(p: tuple, q: tuple | None) -> int:
        return close_pairs(p, q, limit)

    for level, whole, cells, direct in _refine(spots, by, True, only, C.few_rows):
        home = _first_cell(level)
        if cells is not None:
            # the rows of crowded cells move once for each of their pairs, not once for each point
            crowded = cells.where(~C.few_pairs())
            if not crowded.isEmpty():
                found = C.measured_pairs(spots, crowded, level, by, measure, "n")
                parts.append(found.select(*by, *home, "n"))
        if whole is not None:
            parts.append(
                whole.where(~same_cell).select(*by, *home, (F.col("p_w") * F.col("q_w")).alias("n"))
            )
            # inside one cell: all pairs of its points, less those of coincident ones
            inner = whole.where(same_cell).select(
                *by, F.col("px").alias("cx"), F.col("py").alias("cy")
            )
            parts.append(
                inner.join(C.at_level(spots, level), [*by, "cx", "cy"])
                .groupBy(*by, "cx", "cy")
                .agg(F.expr("(sum(w) * sum(w) - sum(w * w)) div 2").alias("n"))
                .select(*by, *_first_cell(level, "cx", "cy"), "n")
            )
        parts.append(
            direct.where(spot_order & _close(r)).select(
                *by, *home, (F.col("p_w") * F.col("q_w")).alias("n")
            )
        )
    return functools.reduce(DataFrame.unionByName, parts)


def _spots(points: DataFrame, r: float, by: list[str]) -> DataFrame:
    """Coincident points folded into one with a weight ``w``."""
    return _scaled(points.groupBy(*by, "x", "y").agg(F.count("*").alias("w")), r)


def count_close_pairs(points: DataFrame, r: float, by: Sequence[str]) -> DataFrame:
    """``by, n``: exact number of unordered pairs closer than 2r, per group.

    Coincident points fold into one weighted point.  Cells of side 2r are
    paired with their neighbours; a pair of cells is counted as a whole (all
    pairs close, or none), compared point by point when that is cheap, or split.
    """
    by = list(by)
    # every level reads the spots; the sums are combined per task before they move
    spots = stored(_spots(points, r, by), "spots")
    return _close_counts(spots, r, by).groupBy(*by).agg(F.sum("n").alias("n"))


def _close_id_pairs(points: DataFrame, r: float, by: Sequence[str]) -> DataFrame:
    """``by, u, v`` with u < v: the pairs of ids closer than 2r.

    Coincident vertices are one spot until the end.  Crowded cells are split
    until a pair of cells yields few pairs of spots.  A spot of one vertex carries its
    id, so its pairs go out where they are found; only pairs with a spot of several
    vertices move once more, to meet their ids.
    """
    by = list(by)
    ids = points.select(*by, "id", "x", "y")
    # one table of spots for all levels
    folded = ids.groupBy(*by, "x", "y").agg(F.count("*").alias("w"), F.min("id").alias("id"))
    spots = materialize(_scaled(folded, r))
    x1, y1, x2, y2 = (F.col(c) for c in ("p_x", "p_y", "q_x", "q_y"))
    spot_order = _once((x1 < x2) | ((x1 == x2) & (y1 < y2)))
    close = functools.reduce(
        DataFrame.unionByName,
        [
            direct.where(spot_order & _close(r)).select(
                *by, *[f"{side}_{c}" for side in "pq" for c in ("x", "y", "w", "id")]
            )
            for _, _, _, direct in _refine(spots, by, False, few=C.few_listed)
        ],
    )
    single = (F.col("p_w") == 1) & (F.col("q_w") == 1)
    found = close.where(single).select(*by, F.col("p_id").alias("p"), F.col("q_id").alias("q"))
    crowded = spots.where("w > 1").select(*by, F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    if not crowded.isEmpty():

        def named(name: str) -> DataFrame:
            return ids.select(
                *by,
                F.col("id").alias(name),
                F.col("x").alias(f"{name}_x"),
                F.col("y").alias(f"{name}_y"),
            )

        apart = close.where(~single).select(*by, "p_x", "p_y", "q_x", "q_y")
        apart = apart.join(named("p"), [*by, "p_x", "p_y"]).join(named("q"), [*by, "q_x", "q_y"])
        same = (
            crowded.join(named("p"), [*by, "p_x", "p_y"])
            .join(named("q").toDF(*by, "q", "p_x", "p_y"), [*by, "p_x", "p_y"])
            .where("p < q")
        )
        found = found.unionByName(apart.select(*by, "p", "q")).unionByName(same.select(*by, "p", "q"))
    return found.select(*by, F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))


def occluded_pairs(layout: DataFrame, r: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """The pairs themselves, each once, ids in string order."""
    return _close_id_pairs(layout, r, by)


def node_occlusion(layout: DataFrame, r: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """Exact count, whole cells at a time."""
    counts = count_close_pairs(layout.select(*by, "x", "y"), r, by)
    # a group always has its spots, so no layout is missing
    return counts.select(*by, F.col("n").cast("bigint").alias("node_occlusion"))


def node_occlusion_grid(layout: DataFrame, r: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """The same; the name of the variant on a grid, which has become the only one."""
    return node_occlusion(layout, r, by)


def disc_cells(layout: DataFrame, r: float = 0.01, by: Sequence[str] = BY) -> DataFrame:
    """Cells of side 2r that the disc of radius r around each vertex touches.

    ``by, id, x, y, cell_x, cell_y``: the home cell, a side when the disc
    reaches over it, a corner when the corner lies within r.
    """
    side = 2.0 * r
    x, y = F.col("x"), F.col("y")
    hx, hy = floor_div(x, side), floor_div(y, side)

    def over(axis: Column, home: Column, step: int) -> Column:
        return floor_div(axis + F.lit(float(step * r)), side) != home

    def to_edge(axis: Column, home: Column, step: int) -> Column:
        return (home + (1 if step > 0 else 0)) * F.lit(side) - axis

    cells = [F.struct(hx.alias("cell_x"), hy.alias("cell_y"))]
    for sx in (-1, 0, 1):
        for sy in (-1, 0, 1):
            if sx == sy == 0:
                continue
            if sx and sy:
                ex, ey = to_edge(x, hx, sx), to_edge(y, hy, sy)
                touched = ex * ex + ey * ey <= F.lit(float(r)) * F.lit(float(r))
            else:
                touched = over(x, hx, sx) if sx else over(y, hy, sy)
            cells.append(
                F.when(touched, F.struct((hx + sx).alias("cell_x"), (hy + sy).alias("cell_y")))
            )
    return layout.select(*by, "id", "x", "y", F.inline(F.array_compact(F.array(*cells))))


def node_occlusion_cellsum(
    layout: DataFrame, r: float = 0.01, by: Sequence[str] = BY
) -> DataFrame:
    """Pairs per disc cell, summed: a pair counts once for each cell it shares."""
    per_cell = count_close_pairs(disc_cells(layout, r, by), r, [*by, "cell_x", "cell_y"])
    return per_cell.groupBy(*by).agg(F.sum("n").cast("bigint").alias("node_occlusion"))


def node_occlusion_hll(
    layout: DataFrame, r: float = 0.01, rsd: float = 0.02, by: Sequence[str] = BY
) -> DataFrame:
    """Approximate number of distinct pairs that share a disc cell.

    Up to ``LISTED_PAIRS`` are listed and hashed.  Of more, only those are met that can change
    the sketch (``functions.sketch``), unless a cell has more vertices than a task may hold.
    """
    by = list(by)
    cells, key = disc_cells(layout, r, by), [*by, "cell_x", "cell_y"]
    n = F.col("n")
    sizes = materialize(
        cells.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .groupBy(*by)
        .agg(F.sum(n * (n - 1) / 2).alias("possible"), F.max("n").alias("most"))
    )
    possible, most = sizes.agg(
        F.coalesce(F.max("possible"), F.lit(0.0)), F.coalesce(F.max("most"), F.lit(0))
    ).head()
    if possible > LISTED_PAIRS and most <= C.KERNEL_ROWS:
        return _sketched(layout, cells, sizes, r, rsd, by)
    pairs = _close_id_pairs(cells, r, key)
    pair = F.when(F.col("u").isNotNull(), F.struct("u", "v"))
    # a row without a pair for each layout, which the count does not see
    none = layout.select(*by, F.lit(None).cast("string").alias("u")).distinct()
    rows = pairs.select(*by, "u", "v").unionByName(none.withColumn("v", F.col("u")))
    count = F.approx_count_distinct(pair, rsd)
    return rows.groupBy(*by).agg(count.cast("bigint").alias("node_occlusion"))


def _sketched(
    layout: DataFrame, cells: DataFrame, sizes: DataFrame, r: float, rsd: float, by: list[str]
) -> DataFrame:
    """``by, node_occlusion`` from registers of pairs that each cell finds on its own."""
    bits = max(4, math.ceil(2 * math.log2(1.106 / rsd)))
    registers, limit = 1 << bits, float(2 * r) * float(2 * r)
    key, names = [*by, "cell_x", "cell_y"], [*by, "register", "rank"]
    fields = f"{D.key_fields(layout, by)}{', ' if by else ''}register bigint, rank int"
    few = F.broadcast if sizes.count() <= C.SMALL_PAIRS else lambda rows: rows

    def find(group, table):
        x, y, h, named, zeros = (table.column(c).to_numpy() for c in ("x", "y", "h", "named", "zeros"))
        found, rank = pair_registers(x, y, h, named, limit, int(zeros[0]), bits)
        keys = [pa.array([k.as_py()] * len(found), k.type) for k in group[: len(by)]]
        return pa.Table.from_arrays([*keys, pa.array(found), pa.array(rank)], names=names)

    # about 16 pairs a register if one in eight of the possible pairs is close
    zeros = F.greatest(F.floor(F.log2(F.col("possible") / (128 * registers))), F.lit(0)).cast("int")
    wanted = sizes.select(*by, F.coalesce(zeros, F.lit(0)).alias("zeros"))
    tasks = int(layout.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows = framed(cells, few(wanted), by, "cell_x", "cell_y").select(
            *key, "x", "y", F.xxhash64("id").alias("h"), F.col("id").isNotNull().alias("named"), "zeros"
        )
        hits = rows.repartition(tasks, *key).groupBy(*key).applyInArrow(find, fields)
        best = materialize(hits.groupBy(*by, "register").agg(F.max("rank").alias("rank")))
        sums = best.groupBy(*by).agg(
            F.count("*").alias("held"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s")
        )
        both = sums.unionByName(wanted, allowMissingColumns=True).groupBy(*by).agg(
            *[F.max(c).alias(c) for c in ("held", "s", "zeros")]
        )
        # a register without a pair tells nothing of pairs whose hashes begin with fewer zeros
        if both.where((F.coalesce("held", F.lit(0)) < registers) & (F.col("zeros") > 0)).isEmpty():
            break
        wanted = wanted.withColumn("zeros", F.greatest(F.col("zeros") - 4, F.lit(0)))
    # the estimator of O. Ertl (2017), which needs no correction for small numbers
    empty = 1.0 - F.col("held") / registers
    sigma = functools.reduce(
        lambda total, k: total + F.pow(empty, F.lit(float(2**k))) * 2.0 ** (k - 1), range(1, 32), empty
    )
    counts = sums.withColumn("n", F.round(registers**2 / (2 * math.log(2)) / (registers * sigma + F.col("s"))))
    return zero_filled(layout, counts, by).select(*by, F.col("n").cast("bigint").alias("node_occlusion"))


def node_occlusion_approx(
    layout: DataFrame,
    r: float = 0.01,
    fraction: float = 0.5,
    seed: int = 7,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Estimate from a hash sample of the vertices, scaled by 1 / fraction^2."""
    sample = layout.where(unit_hash(F.col("id"), seed) < F.lit(float(fraction)))
    counts = count_close_pairs(sample.select(*by, "x", "y"), r, by)
    scaled = F.col("n") / F.lit(fraction * fraction)
    return zero_filled(layout, counts, by).select(*by, scaled.alias("node_occlusion"))


def _part_of(x: Column, y: Column, parts: int) -> Column:
    """The part of the work that a cell belongs to, by a hash."""
    return F.floor(unit_hash(F.concat_ws(":", x, y), 7) * F.lit(parts)).cast("int")


def _until(deadline: float, spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame | None:
    """``build()``, or None if it is not there by the ``deadline``; then its jobs are cancelled."""
    sc, tag, out, failed = spark.sparkContext, f"occlusion-{uuid.uuid4().hex}", [], []

    def run():
        sc.addJobTag(tag)
        try:
            out.append(build())
        except Exception as error:  # told apart below
            failed.append(error)
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=run)
    thread.start()
    thread.join(max(0.0, deadline - time.monotonic()) if deadline < math.inf else None)
    late = thread.is_alive()
    while thread.is_alive():
        sc.cancelJobsWithTag(tag)
        thread.join(0.1)
    if failed and not late:
        raise failed[0]
    return out[0] if out else None


def _estimate(found: DataFrame | None, possible: DataFrame, by: list[str], done: int, parts: int, confidence: float):
    """What ``done`` of ``parts`` say of all of them, by the ratio of found to possible pairs."""
    seen = possible.where(F.col("part") < done).withColumn("n", F.lit(0).cast("bigint"))
    rows = seen.select(*by, "part", "n", "z").unionByName(
        possible.select(*by, "part", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("z"))
    )
    if found is not None:
        rows = rows.unionByName(found.select(*by, "part", "n", F.lit(0).cast("bigint").alias("z")))
    rows = rows.groupBy(*by, "part").agg(F.sum("n").alias("n"), F.sum("z").alias("z"))
    total = possible.groupBy(*by).agg(F.sum("z").alias("total"))
    x, z = F.col("n").cast("double"), F.col("z").cast("double")
    sums = rows.groupBy(*by).agg(
        F.sum("n").alias("least"),
        F.sum("z").alias("seen"),
        F.sum(x * x).alias("nn"),
        F.sum(x * z).alias("nz"),
        F.sum(z * z).alias("zz"),
    )
    # each layout has a row on both sides
    both = sums.unionByName(total, allowMissingColumns=True).groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("least", "seen", "nn", "nz", "zz", "total")]
    )
    ratio = F.coalesce(F.try_divide("least", "seen"), F.lit(0.0))
    rest = (F.col("total") - F.col("seen")).cast("double")
    errors = F.greatest(F.col("nn") - 2.0 * ratio * F.col("nz") + ratio * ratio * F.col("zz"), F.lit(0.0))
    quantile = NormalDist().inv_cdf(0.5 + confidence / 2)
    scale = parts * parts * (1 - done / parts) / done / (done - 1) if done > 1 else math.inf
    about = F.col("least") + ratio * rest
    margin = F.lit(quantile) * F.sqrt(errors * F.lit(scale)) if done > 1 else F.lit(math.inf)
    most = F.col("least") + rest
    return both.select(
        *by,
        (about if done else F.lit(None).cast("double")).alias("node_occlusion"),
        F.greatest(about - margin, F.col("least").cast("double")).alias("low"),
        F.least(about + margin, most).alias("high"),
        "least",
        most.cast("bigint").alias("most"),
        F.lit(done / parts).alias("share"),
    )


def node_occlusion_within(
    layout: DataFrame,
    r: float = 0.01,
    timeout_ms: float | None = 1000,
    confidence: float = 0.9,
    by: Sequence[str] = BY,
    parts: int = 64,
    at_most: int | None = None,
) -> DataFrame:
    """``by, node_occlusion, low, high, least, most, share``: a count that stops in time.

    The cells are dealt to ``parts`` by a hash, and one, one, two, four and so on of them are
    counted until ``timeout_ms`` are over or ``at_most`` of them are done; the jobs that are
    still running then are cancelled.  Only cell sizes are always made.

    ``share`` of the parts were counted.  ``least`` and ``most`` hold for certain: what
    was found, and that with all pairs of neighbouring cells in the other parts.
    ``node_occlusion`` carries the ratio of found to possible pairs over to the other
    parts (null if none was counted), and the true number lies between ``low`` and
    ``high`` with the given confidence.  With a ``share`` of 1 all of them are exact.
    """
    begin, by, spark = time.monotonic(), list(by), layout.sparkSession
    deadline = math.inf if timeout_ms is None else begin + timeout_ms / 1000
    limit = parts if at_most is None else min(at_most, parts)
    spots = materialize(_spots(layout.select(*by, "x", "y"), r, by))
    pairs = C.neighbour_pairs(C.cell_sizes(spots, 0, by), _HALF_RING, by)
    px, py = F.col("px"), F.col("py")
    same_cell = (px == F.col("qx")) & (py == F.col("qy"))
    all_pairs = F.when(same_cell, F.expr("p_w * (p_w - 1) div 2")).otherwise(F.col("p_w") * F.col("q_w"))
    possible = materialize(
        pairs.groupBy(*by, _part_of(px, py, parts).alias("part")).agg(F.sum(all_pairs).alias("z"))
    )
    found, done = None, 0
    while done < limit and time.monotonic() < deadline:
        upto = min(max(1, 2 * done), limit)
        part = _part_of(px, py, parts)

        def counted(low=done, high=upto, part=part) -> DataFrame:
            rows = _close_counts(spots, r, by, (part >= low) & (part < high))
            home = _part_of(F.col("home_x"), F.col("home_y"), parts)
            return materialize(rows.groupBy(*by, home.alias("part")).agg(F.sum("n").alias("n")))

        step = _until(deadline, spark, counted)
        if step is None:
            break
        found, done = step if found is None else found.unionByName(step), upto
    return _estimate(found, possible, by, done, parts, confidence)
