"""Sums of (z - z') / |z - z'|^2 over all other points, without all pairs.

The field of a distant cell is replaced by its multipole expansion (Greengard
and Rokhlin's fast multipole method for the 2-D Coulomb kernel): with points
as complex numbers the sum is the conjugate of sum(1 / (z - z')).  Pairs of
cells are refined as in ``plans.cells``; a pair that is not adjacent is settled
by translating the expansion of one into a local expansion of the other, the
rest is summed point by point.  ``ORDER`` terms leave a relative error near
1e-12, the size of the rounding in a plain sum of that many terms.

Points move in packets: those of a leaf (the smallest cell of a point that is in any
pair) are one row of packed numbers.  Expansions are one row per cell, and a leaf holds
some hundred points, so all levels are passed at once: a task raises the moments of its
leaves to all cells above them, and a leaf gets the field of all cells around it in one
shuffle, whatever the number of levels.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.messages import framed
from ..session import materialize
from . import cells as C
from .dominance import key_fields

ORDER = 44
# the first level whose cells are paired with all others: at most 64 per layout
START_LEVEL = 3
# an expansion is one value, its complex terms as bytes: a plan with a column for each
# term takes longer to compile than to run
_TERMS = "terms"
_BYTES = 16 * ORDER
# a point in a packet: x, y, w
_SPOT_BYTES = 24
# two adjacent cells are summed point by point once the product of their sizes is this many
# times ``PAIR_BUDGET``: a leaf holds up to 512 points, so that expansions are far fewer than points
SPOT_PAIRS = 16
# leaves that are broadcast to the points
SMALL_LEAVES = 500_000
# packets whose points a task evaluates at once
EVALUATED = 500


def _few_spots():
    return F.col("p_points") * F.col("q_points") <= SPOT_PAIRS * C.PAIR_BUDGET


def _complex(batch) -> np.ndarray:
    data = b"".join(batch.column(_TERMS).to_pylist())
    return np.frombuffer(data, complex).reshape(-1, ORDER)


def _as_bytes(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * _BYTES
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(values), buffers)


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _folded(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, sums of the expansions) of the different keys."""
    unique, group = np.unique(np.stack(keys), axis=1, return_inverse=True)
    order = np.argsort(group.reshape(-1), kind="stable")
    starts = np.searchsorted(group.reshape(-1)[order], np.arange(unique.shape[1]))
    return list(unique), np.add.reduceat(values[order], starts, axis=0)


def _layouts(batch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the layout of each row, a row of each layout)."""
    codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in by]
    _, first, group = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)
    return group.reshape(-1), first


def _powers(z: np.ndarray) -> np.ndarray:
    """1, z, z^2, ... as columns."""
    out = np.empty((len(z), ORDER), dtype=complex)
    out[:, 0] = 1.0
    np.multiply.accumulate(np.repeat(z[:, None], ORDER - 1, axis=1), axis=1, out=out[:, 1:])
    return out


def _offset(batch, level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each point and its place in it, in units of the cell side."""
    scale = np.exp2(level)
    u, v = batch.column("u").to_numpy() * scale, batch.column("v").to_numpy() * scale
    cx, cy = np.floor(u), np.floor(v)
    return cx.astype(np.int64), cy.astype(np.int64), (u - cx - 0.5) + 1j * (v - cy - 0.5)


def _sums(df: DataFrame, key: list[str]) -> DataFrame:
    """The sum of the expansions of each cell."""

    def add(batches):
        # rows of a cell are adjacent; the last cell of a batch may go on in the next one
        last, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in key]
            starts = _starts(columns)
            sums = np.add.reduceat(_complex(batch), starts, axis=0)
            rows = [tuple(c[int(i)] for c in columns) for i in (starts[0], starts[-1])]
            if last is not None and tuple(v.as_py() for v in rows[0]) == tuple(v.as_py() for v in last):
                sums[0] += carried
            elif last is not None:
                yield one(last, carried)
            if len(starts) > 1:
                done = pa.array(starts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(done) for c in columns], _as_bytes(sums[:-1])], names=[*key, _TERMS]
                )
            last, carried = rows[1], sums[-1]
        if last is not None:
            yield one(last, carried)

    def one(values, total):
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v.as_py()], v.type) for v in values], _as_bytes(total[None])], names=[*key, _TERMS]
        )

    rows = df.select(*key, _TERMS).repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(add, f"{key_fields(df, key)}, {_TERMS} binary")


def _packets(leafed: DataFrame, by: list[str]) -> DataFrame:
    """``by, level, cx, cy, x0, y0, side, spots, terms``: the points of a leaf and their moments.

    ``spots`` are packed numbers x, y, w of each point.  A leaf that a batch ends in has
    several rows.
    """
    key = [*by, "level", "cx", "cy"]
    frame = ["x0", "y0", "side"]

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts([batch.column(c) for c in key])
            w = batch.column("w").to_numpy().astype(float)
            _, _, z = _offset(batch, batch.column("level").to_numpy().astype(float))
            moments = np.add.reduceat(_powers(z) * w[:, None], starts, axis=0)
            spots = np.stack([batch.column("x").to_numpy(), batch.column("y").to_numpy(), w], axis=1)
            offsets = np.append(starts, batch.num_rows).astype(np.int32) * _SPOT_BYTES
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spots))]
            first = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(first) for c in (*key, *frame)],
                    pa.Array.from_buffers(pa.binary(), len(starts), buffers),
                    _as_bytes(moments),
                ],
                names=[*key, *frame, "spots", _TERMS],
            )

    fields = f"{key_fields(leafed, [*key, *frame])}, spots binary, {_TERMS} binary"
    rows = leafed.repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(pack, fields)


def _spots(column) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, w of the points of packets, how many each packet holds)."""
    packets = column.to_pylist()
    sizes = np.array([len(p) // _SPOT_BYTES for p in packets], np.int64)
    return np.frombuffer(b"".join(packets)).reshape(-1, 3), sizes


def _quadrants() -> tuple[np.ndarray, np.ndarray]:
    """(moments of a child to those of its parent, a parent's field to its child's), by quadrant.

    In units of each cell's side: a child's place z is z / 2 + d in its parent.
    """
    n = np.arange(ORDER)
    binomial = np.array([[float(comb(i, j)) for j in n] for i in n])
    up, down = [], []
    for quadrant in range(4):
        d = ((quadrant & 1) - 0.5) / 2 + 1j * ((quadrant >> 1) - 0.5) / 2
        # d ** (i - j) * 2 ** -j for i >= j; the binomials are 0 elsewhere
        shift = d ** np.maximum(n[:, None] - n, 0) * 0.5**n * binomial
        up.append(shift.T)
        down.append(shift / 2)
    return np.array(up), np.array(down)


def _translated(values: np.ndarray, x: np.ndarray, y: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """Expansions of the cells (x, y) as shares of their parents, or of their parents as theirs."""
    quadrant = (x & 1) + 2 * (y & 1)
    out = np.empty_like(values)
    for q in range(4):
        rows = quadrant == q
        out[rows] = values[rows] @ matrices[q]
    return out


def _leaves(used: DataFrame, by: list[str]) -> DataFrame:
    """``by, leaf, leaf_x, leaf_y, level, cx, cy``: the cells in pairs that hold no smaller one
    in any pair, once for each of the cells around them and themselves."""
    key = [*by, "level", "cx", "cy"]
    around = used.select(
        *by,
        *[F.col(c).alias(name) for c, name in zip(("level", "cx", "cy"), ("leaf", "leaf_x", "leaf_y"))],
        F.explode(F.sequence(F.lit(START_LEVEL), F.col("level"))).alias("level"),
    ).select(
        "*",
        F.expr("shiftright(leaf_x, leaf - level)").alias("cx"),
        F.expr("shiftright(leaf_y, leaf - level)").alias("cy"),
    )
    above = around.where(F.col("level") < F.col("leaf")).select(*key).distinct()
    split = above.toDF(*by, "leaf", "leaf_x", "leaf_y")
    return materialize(around.join(split, [*by, "leaf", "leaf_x", "leaf_y"], "left_anti"))


def _leafed(points: DataFrame, leaves: DataFrame, by: list[str], levels: list[int]) -> DataFrame:
    """The points, each with the leaf that it lies in."""
    own = leaves.where(F.col("level") == F.col("leaf")).select(*by, "level", "cx", "cy")
    if own.count() <= SMALL_LEAVES:
        own = F.broadcast(own)
    return points.select("*", F.inline(_cells_of(levels))).join(own, [*by, "level", "cx", "cy"])


def _moments(packets: DataFrame, by: list[str]) -> DataFrame:
    """``by, level, cx, cy, terms``: moments of the leaves and of all cells around them."""
    key = [*by, "level", "cx", "cy"]
    up = _quadrants()[0]

    def raised(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            layout, first = _layouts(batch, by)
            own, cx, cy = (batch.column(c).to_numpy() for c in ("level", "cx", "cy"))
            terms = _complex(batch)
            cells, values = [np.empty(0, np.int64)] * 3, np.empty((0, ORDER), complex)
            for level in range(int(own.max()), START_LEVEL - 1, -1):
                here = own == level
                cells, values = _folded(
                    [np.append(a, b[here]) for a, b in zip(cells, (layout, cx, cy))],
                    np.concatenate((values, terms[here])),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(pa.array(first[cells[0]])) for c in by],
                        pa.array(np.full(len(values), level, np.int32)),
                        *map(pa.array, cells[1:]),
                        _as_bytes(values),
                    ],
                    names=[*key, _TERMS],
                )
                values = _translated(values, *cells[1:], up)
                cells = [cells[0], cells[1] >> 1, cells[2] >> 1]

    schema = f"{key_fields(packets, key)}, {_TERMS} binary"
    return _sums(packets.select(*key, _TERMS).mapInArrow(raised, schema), key)


def _leaf_fields(local: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """``by, level, cx, cy, terms``: the field of all distant cells at the leaves, with what the
    cells around them pass on."""
    key = [*by, "level", "cx", "cy"]
    down = _quadrants()[1]

    def lowered(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            layout, first = _layouts(batch, by)
            leaf, cx, cy = (batch.column(c).to_numpy() for c in ("leaf", "leaf_x", "leaf_y"))
            level, values = batch.column("level").to_numpy().copy(), _complex(batch).copy()
            while len(rows := np.flatnonzero(level < leaf)):
                level[rows] += 1
                above = (leaf[rows] - level[rows]).astype(np.int64)
                values[rows] = _translated(values[rows], cx[rows] >> above, cy[rows] >> above, down)
            cells, values = _folded([layout, leaf.astype(np.int64), cx, cy], values)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(first[cells[0]])) for c in by],
                    pa.array(cells[1].astype(np.int32)),
                    *map(pa.array, cells[2:]),
                    _as_bytes(values),
                ],
                names=[*key, _TERMS],
            )

    schema = f"{key_fields(local, key)}, {_TERMS} binary"
    return _sums(leaves.join(local, key).mapInArrow(lowered, schema), key)


def _local_expansions(far: DataFrame, moments: DataFrame, by: list[str]) -> DataFrame:
    """``by, level, cx, cy, terms``: the field of all distant cells around a cell."""
    key = [*by, "level", "cx", "cy"]
    pascal = np.array([[float(comb(m + n, n)) for n in range(ORDER)] for m in range(ORDER)])
    signs = -((-1.0) ** np.arange(ORDER))

    def translate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            step = 1.0 / (batch.column("dx").to_numpy() + 1j * batch.column("dy").to_numpy())
            power = _powers(step)
            source = _complex(batch) * (signs * power * step[:, None])
            # two real products: the binomials are real
            local = ((source.real @ pascal) + 1j * (source.imag @ pascal)) * power
            layout, first = _layouts(batch, by)
            level, cx, cy = (batch.column(c).to_numpy() for c in ("level", "cx", "cy"))
            cells, local = _folded([layout, level.astype(np.int64), cx, cy], local)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(first[cells[0]])) for c in by],
                    pa.array(cells[1].astype(np.int32)),
                    *map(pa.array, cells[2:]),
                    _as_bytes(local),
                ],
                names=[*key, _TERMS],
            )

    pairs = far.select(
        *by,
        "level",
        F.col("px"),
        F.col("py"),
        F.col("qx").alias("cx"),
        F.col("qy").alias("cy"),
    )
    schema = f"{key_fields(moments, key)}, {_TERMS} binary"
    return _sums(
        pairs.join(moments.hint("merge"), key)
        .select(
            *by,
            "level",
            F.col("px").alias("cx"),
            F.col("py").alias("cy"),
            (F.col("cx") - F.col("px")).cast("double").alias("dx"),
            (F.col("cy") - F.col("py")).cast("double").alias("dy"),
            _TERMS,
        )
        .mapInArrow(translate, schema),
        key,
    )


def _block_sums(tx, ty, sx, sy, w) -> tuple[np.ndarray, np.ndarray]:
    """Plain sums at the targets over all sources but those in the same place."""
    fx, fy = np.zeros(len(tx)), np.zeros(len(tx))
    # blocks that stay in a cache
    for left in range(0, len(sx), 2048):
        some = slice(left, left + 2048)
        x, y, weight = sx[some], sy[some], w[some]
        for begin in range(0, len(tx), 16):
            rows = slice(begin, begin + 16)
            dx, dy = tx[rows, None] - x, ty[rows, None] - y
            d2 = dx * dx
            d2 += dy * dy
            d2[d2 == 0] = np.inf
            share = np.divide(weight, d2, out=d2)
            fx[rows] += np.einsum("ij,ij->i", dx, share)
            fy[rows] += np.einsum("ij,ij->i", dy, share)
    return fx, fy


def _cells_of(levels: list[int]):
    """The cell of a point at each level, as an array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.floor(F.col("u") * float(2**level)).cast("bigint").alias("cx"),
                F.floor(F.col("v") * float(2**level)).cast("bigint").alias("cy"),
            )
            for level in levels
        ]
    )


def _near_sums(packets: DataFrame, near: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """Plain sums over adjacent cells.

    The packets of a cell meet copies of the packets of its neighbours, at most
    nine cells whose sizes the budget bounds.
    """
    key = [*by, "level", "px", "py"]
    leaf = ["leaf", "leaf_x", "leaf_y"]
    names = [*by, "x", "y", "fx", "fy"]

    def within(name: str) -> DataFrame:
        return leaves.select(
            *by, "level", F.col("cx").alias(f"{name}x"), F.col("cy").alias(f"{name}y"), *leaf
        )

    sources = near.join(within("q"), [*by, "level", "qx", "qy"])
    targets = near.select(*key).distinct().join(within("p"), key)
    wanted = targets.select(*key, *leaf, F.lit(True).alias("target")).unionByName(
        sources.select(*key, *leaf, F.lit(False).alias("target"))
    )
    held = packets.select(
        *by, *[F.col(c).alias(name) for c, name in zip(("level", "cx", "cy"), leaf)], "spots"
    )
    rows = wanted.join(held, [*by, *leaf]).select(*key, "target", "spots")

    def add_up(group, table):
        is_target = table.column("target").to_numpy().astype(bool)
        packed = table.column("spots")
        target, _ = _spots(packed.filter(pa.array(is_target)))
        source, _ = _spots(packed.filter(pa.array(~is_target)))
        x, y = np.ascontiguousarray(target[:, 0]), np.ascontiguousarray(target[:, 1])
        fx, fy = _block_sums(x, y, *np.ascontiguousarray(source.T))
        layout = [pa.repeat(group[i], len(x)) for i in range(len(by))]
        return pa.table([*layout, pa.array(x), pa.array(y), pa.array(fx), pa.array(fy)], names=names)

    # few bytes can be much work: a number of tasks that adaptive execution keeps
    tasks = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"{key_fields(packets, by)}, x double, y double, fx double, fy double"
    return rows.repartition(tasks, *key).groupBy(*key).applyInArrow(add_up, schema)


def _evaluate(packets: DataFrame, local: DataFrame, by: list[str]) -> DataFrame:
    """The distant field at each point, from the leaf that it lies in."""

    def field(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, EVALUATED):
                batch = whole.slice(begin, EVALUATED)
                spots, sizes = _spots(batch.column("spots"))
                row = np.repeat(np.arange(batch.num_rows), sizes)

                def of(name):
                    return batch.column(name).to_numpy()[row]

                scale, side = np.exp2(of("level").astype(float)), of("side")
                u, v = (spots[:, 0] - of("x0")) / side * scale, (spots[:, 1] - of("y0")) / side * scale
                z = (u - of("cx") - 0.5) + 1j * (v - of("cy") - 0.5)
                terms = np.ascontiguousarray(_complex(batch).T)
                total = np.zeros(len(z), complex)
                for term in terms[::-1]:
                    total *= z
                    total += term[row]
                total *= scale / side
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(pa.array(row)) for c in by],
                        pa.array(np.ascontiguousarray(spots[:, 0])),
                        pa.array(np.ascontiguousarray(spots[:, 1])),
                        pa.array(np.ascontiguousarray(total.real)),
                        pa.array(-total.imag),
                    ],
                    names=[*by, "x", "y", "fx", "fy"],
                )

    schema = f"{key_fields(packets, by)}, x double, y double, fx double, fy double"
    key = [*by, "level", "cx", "cy"]
    return (
        packets.drop(_TERMS)
        .join(local.hint("merge"), key)
        .select(*key, "x0", "y0", "side", "spots", _TERMS)
        .mapInArrow(field, schema)
    )


def inverse_sums(spots: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, x, y, fx, fy``: sum of w' (p - p') / |p - p'|^2 over the other spots.

    ``spots`` are distinct positions ``by, x, y`` with a weight ``w``.
    """
    by = list(by)
    # read for the frame and for the points
    return _expanded_sums(materialize(spots.select(*by, "x", "y", "w")), by)


def _expanded_sums(spots: DataFrame, by: list[str]) -> DataFrame:
    width, height = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    frame = spots.groupBy(*by).agg(
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.greatest(width, height) * (1 + 1e-9)).alias("side"),
    )
    points = (
        framed(spots, frame, by, "x", "y")
        .withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))
        .withColumns(
            {
                "u": (F.col("x") - F.col("x0")) / F.col("side"),
                "v": (F.col("y") - F.col("y0")) / F.col("side"),
            }
        )
        .select(*by, "x", "y", "w", "u", "v", "x0", "y0", "side")
    )
    points = materialize(points)
    top = C.cell_sizes(points, START_LEVEL, by)
    reach = range(-(2**START_LEVEL) + 1, 2**START_LEVEL)
    start = C.neighbour_pairs(top, [(dx, dy) for dx in reach for dy in reach], by)

    def classify(level: int):
        apart = F.greatest(
            F.abs(F.col("px") - F.col("qx")), F.abs(F.col("py") - F.col("qy"))
        )
        return apart > 1, F.lit(False)

    levels, far, near, cells = [], [], [], []
    for level, distant, direct in C.refine(
        points, by, start, classify, True, True, start=START_LEVEL, few=_few_spots
    ):
        levels.append(level)
        at = F.lit(level).alias("level")
        pair = [*by, at, "px", "py", "qx", "qy"]
        far.append(distant.select(*pair))
        near.append(direct.select(*pair))
        both = distant.select(*pair).unionByName(direct.select(*pair))
        cells.append(both.select(*by, "level", F.col("px").alias("cx"), F.col("py").alias("cy")))
    used = functools.reduce(DataFrame.unionByName, cells).distinct()
    leaves = _leaves(used, by)
    # read for the moments, the field of distant cells and the plain sums
    packets = materialize(_packets(_leafed(points, leaves, by, levels), by))
    far_pairs = functools.reduce(DataFrame.unionByName, far)
    adjacent = functools.reduce(DataFrame.unionByName, near)
    local = _local_expansions(far_pairs, _moments(packets, by), by)
    return (
        _evaluate(packets, _leaf_fields(local, leaves, by), by)
        .unionByName(_near_sums(packets, adjacent, leaves, by))
        .groupBy(*by, "x", "y")
        .agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    )
