"""Inverted pairs of strips of any size, with rows that travel in packets.

A strip is cut into chunks along either border, as in ``dominance``, but the cuts are
taken from a sample first.  So a piece needs no table of its own between the two
counts: it travels once to its left chunk, with both heights, and once to its right
chunk, with the number of the left one.  Pieces of a task with the same target are one
row of packed numbers, 26 bytes a piece in all, and the chunk intersections are added
up before they move.

The cuts decide sizes only; counts do not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hinges import kinks
from ..functions.inversions import inverted_pairs
from .dominance import key_fields, one_row

# sampled pieces for each chunk that is cut
SAMPLED = 100
# pieces that a task packs at once
PACK_ROWS = 1_000_000
# rows of packets for a task, or a chunk if that is larger
TASK_ROWS = 1_000_000
_LEFT, _RIGHT, _BOTH = 0, 1, 2


def _cuts(heights: np.ndarray, chunks: int) -> tuple[np.ndarray, int]:
    """(heights that part the sample into chunks, how often the commonest height comes)."""
    if not len(heights):
        return np.empty(0), 0
    heights = np.sort(heights)
    at = (np.arange(1, chunks) * len(heights)) // chunks
    edges = np.flatnonzero(np.diff(heights)) + 1
    runs = np.diff(np.concatenate(([0], edges, [len(heights)])))
    return np.unique(heights[at]), int(runs.max())


def _steep(theta: np.ndarray, bend: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles that some piece can exceed by ``bend`` and, raised by it, those that can be exceeded."""
    return theta[theta > bend - math.pi / 2], theta[theta < math.pi / 2 - bend] + bend


def chunk_cuts(
    pieces: DataFrame, key: Sequence[str], max_rows: int, chunk_rows: int, bends: Sequence[float] = ()
) -> tuple[dict, float] | None:
    """({strip: (cuts on the left, cuts on the right, cuts of the angles for each bend)} of strips
    with more than one chunk, about how many pieces there are), or None if more than
    ``max_rows`` pieces share a height or an angle.

    The driver gets a number for each ``chunk_rows`` pieces.
    """
    key = list(key)
    fraction = min(1.0, SAMPLED / chunk_rows)
    names = [*key, "n", "tied", "cuts"]
    heights = ["ly", "ry", *(["theta"] if bends else [])]

    def cut(group_key, table):
        n = table.num_rows / fraction
        chunks = max(1, int(-(-n // chunk_rows)))
        found = [table.column(c).to_numpy() for c in heights]
        along = [*found[:2], *(np.concatenate(_steep(found[2], bend)) for bend in bends)]
        cuts, tied = zip(*(_cuts(h, chunks) for h in along))
        arrays = [pa.array([k.as_py()], type=k.type) for k in group_key]
        arrays += [pa.array([n]), pa.array([max(tied) / fraction])]
        arrays += [pa.array([[c.tolist() for c in cuts]], type=pa.list_(pa.list_(pa.float64())))]
        return pa.Table.from_arrays(arrays, names=names)

    fields = "n double, tied double, cuts array<array<double>>"
    sample = pieces.select(*key, *heights)
    if fraction < 1:
        sample = sample.sample(fraction, 7)
    found = sample.groupBy(*key).applyInArrow(cut, f"{key_fields(pieces, key)}, {fields}").collect()
    # one height of a few pieces is no matter, whatever the sizes asked for
    if any(r.tied > max(max_rows, chunk_rows) for r in found):
        return None
    if any(len(c) >= 1 << 16 for r in found for c in r.cuts):
        return None
    cuts = {
        tuple(r[c] for c in key): [np.array(c, dtype=float) for c in r.cuts]
        for r in found
        if any(len(c) for c in r.cuts)
    }
    return cuts, sum(r.n for r in found)


def _labels(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right").astype(np.uint16)


def _packets(term, of_left, of_right, split, a, b, c, w, totals):
    """The packets ``term, side, chunk, a, b, c, w`` of some pieces of a strip.

    To the left chunk go both heights ``a, b``; to the right one the number of the left
    chunk and ``b``.  ``split`` tells whether there are several chunks on the left and on
    the right; chunk intersections have both numbers and the ``totals`` of columns.
    """
    routes = [] if a is None else [(_LEFT, of_left, a)]
    if split[0]:  # otherwise all pairs share the left chunk
        routes.append((_RIGHT, of_right, of_left))
    for side, chunk, first in routes:
        order = np.argsort(chunk, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            weights = w[rows]
            packed = None if (weights == 1).all() else weights.tobytes()
            third = None if c is None else c[rows].tobytes()
            at = int(chunk[rows[0]])
            yield term, side, at, first[rows].tobytes(), b[rows].tobytes(), third, packed
    if all(split):
        both = of_left.astype(np.int64) << 16 | of_right
        met, where = np.unique(both, return_inverse=True)
        sums = [np.zeros(len(met), dtype=t.dtype) for t in totals]
        for out, values in zip(sums, totals):
            np.add.at(out, where.reshape(-1), values)
        one, two = (met >> 16).astype(np.uint16), (met & 0xFFFF).astype(np.uint16)
        third = b"".join(x.tobytes() for x in sums)
        yield term, _BOTH, 0, one.tobytes(), two.tobytes(), third, None


def _packed(pieces: DataFrame, key: list[str], columns: list[str], packets: Callable, at_once: int) -> DataFrame:
    """``key, term, side, chunk, a, b, c, w``: what ``packets`` yields of the columns of each strip.

    ``w`` is null if all weights are 1.
    """
    names = [*key, "term", "side", "chunk", "a", "b", "c", "w"]
    types = [pa.int32()] * 3 + [pa.binary()] * 4

    def pack(table: pa.Table):
        keys = [table.column(c).combine_chunks() for c in key]
        number = np.zeros(table.num_rows, dtype=np.int64)
        for column in keys:
            code = column.dictionary_encode().indices.to_numpy()
            number = number * (int(code.max()) + 1) + code
        order = np.argsort(number, kind="stable")
        values = [table.column(c).to_numpy()[order] for c in columns]
        begins = np.concatenate(([0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]))
        out, taken = [], []
        for begin, end in zip(begins[:-1], begins[1:]):
            strip = tuple(c[int(order[begin])].as_py() for c in keys)
            rows = list(packets(strip, *(v[begin:end] for v in values)))
            out += rows
            taken += [int(order[begin])] * len(rows)
        keys = [c.take(pa.array(taken, pa.int64())) for c in keys]
        arrays = [pa.array(v, type=t) for v, t in zip(zip(*out), types)]
        return pa.Table.from_arrays([*keys, *arrays], names=names).to_batches(max_chunksize=2_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= at_once:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from pack(pa.Table.from_batches(held))

    numbers = "term int, side int, chunk int, a binary, b binary, c binary, w binary"
    schema = f"{key_fields(pieces, key)}, {numbers}"
    return pieces.select(*key, *columns).mapInArrow(run, schema)


def _joined(packets: list, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(packets), dtype=dtype)


def _weights(table, sizes: list[int]) -> np.ndarray:
    packed = table.column("w").to_pylist()
    weight = np.ones(sum(sizes), dtype=np.int64)
    if any(x is not None for x in packed):
        for end, size, x in zip(np.cumsum(sizes), sizes, packed):
            if x is not None:
                weight[end - size : end] = np.frombuffer(x, dtype=np.int64)
    return weight


def _folded(a: list, b: list, c: list, dtypes: list) -> tuple:
    """(left chunks, right chunks, total of each column) of the chunk intersections."""
    both = _joined(a, np.uint16).astype(np.int64) << 16 | _joined(b, np.uint16)
    both, where = np.unique(both, return_inverse=True)
    totals = []
    for i, dtype in enumerate(dtypes):
        width = [len(x) // len(dtypes) for x in c]
        values = _joined([x[i * n : (i + 1) * n] for x, n in zip(c, width)], dtype)
        total = np.zeros(len(both), dtype=dtype)
        np.add.at(total, where.reshape(-1), values)
        totals.append(total)
    return both >> 16, both & 0xFFFF, *totals


def _counted(packed: DataFrame, key: list[str], count: Callable, fields: str, total: float, chunk_rows: int):
    """``count`` of the packets of each chunk."""
    target = [*key, "term", "side", "chunk"]
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a task is worth its start, however small the chunks
    tasks = min(max(least, int(total // max(2 * chunk_rows, TASK_ROWS)) + 1), 20_000)
    names = [*key, *(f.split()[0] for f in fields.split(", "))]

    def run(group_key, table):
        term, side = group_key[-3].as_py(), group_key[-2].as_py()
        return one_row(group_key[:-3], names, count(term, side, table))

    schema = f"{key_fields(packed, key)}, {fields}"
    return packed.repartition(tasks, *target).groupBy(*target).applyInArrow(run, schema)


def inverted_in_packets(
    pieces: DataFrame, key: Sequence[str], max_rows: int, chunk_rows: int
) -> DataFrame | None:
    """``key, pairs``: weighted pairs of ``pieces`` (``key, ly, ry, w``) that are inverted between
    the left and the right border of their strip; None if too many pieces share a height."""
    key = list(key)
    found = chunk_cuts(pieces, key, max_rows, chunk_rows)
    if found is None:
        return None
    cuts, total = found
    none = [np.empty(0)] * 2

    def packets(strip, ly, ry, w):
        left, right = cuts.get(strip, none)
        split = len(left) > 0, len(right) > 0
        yield from _packets(0, _labels(left, ly), _labels(right, ry), split, ly, ry, None, w, [w])

    def count(term, side, table):
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        if side == _BOTH:
            first, second, weight = _folded(a, b, c, [np.int64])
        else:
            first = _joined(a, np.float64 if side == _LEFT else np.uint16)
            second = _joined(b, np.float64)
            weight = _weights(table, [len(x) // 8 for x in b])
        n, _, _ = inverted_pairs([first, second], [second, first], weight, weight)
        return (int(n[0]),)

    packed = _packed(pieces, key, ["ly", "ry", "w"], packets, PACK_ROWS)
    counts = _counted(packed, key, count, "pairs bigint", total, chunk_rows)
    return counts.groupBy(*key).agg(F.sum("pairs").alias("pairs"))


def deviations_in_packets(
    pieces: DataFrame, key: Sequence[str], aim: float, max_rows: int, chunk_rows: int
) -> DataFrame | None:
    """``key, crossings, deviation`` of ``pieces`` (``key, ly, ry, theta, w``): every term of
    ``functions.hinges`` as an inversion count in packets.

    Term 0 is the crossings themselves.  For each bend there are three more: of the pieces
    steep enough (points) and those, raised by the bend, that they exceed (queries), all
    pairs, those not below on the left, and those not above on the right.
    """
    key = list(key)
    bends = kinks(aim)
    found = chunk_cuts(pieces, key, max_rows, chunk_rows, [bend for _, bend in bends])
    if found is None:
        return None
    cuts, total = found
    none = [np.empty(0)] * (2 + len(bends))

    def packets(strip, ly, ry, theta, w):
        left, right, *steep = cuts.get(strip, none)
        split = len(left) > 0, len(right) > 0
        totals = [w, w * theta]
        of_left, of_right = _labels(left, ly), _labels(right, ry)
        yield from _packets(0, of_left, of_right, split, ly, ry, theta, w, totals)
        for i, (_, bend) in enumerate(bends):
            point, query = theta > bend - math.pi / 2, theta < math.pi / 2 - bend
            height = np.concatenate((theta[point], theta[query] + bend))
            if not len(height):
                continue
            flag = np.repeat(np.array([0, 1], dtype=np.uint8), [point.sum(), query.sum()])
            weight = np.concatenate((w[point], w[query]))
            wa, wb = np.where(flag == 0, weight, 0), np.where(flag == 1, weight, 0)
            totals = [wa, wb, wa * height, wb * height]
            of_height = _labels(steep[i], height)
            some = len(steep[i]) > 0
            # points before queries: no pair shares the first order
            yield from _packets(
                3 * i + 1, flag.astype(np.uint16), of_height, (True, some), None, height, flag, weight, totals
            )
            for side, (along, at) in enumerate(((-ly, -left[::-1]), (ry, right)), start=2):
                first = np.concatenate((along[point], along[query]))
                label = _labels(at, first)
                yield from _packets(
                    3 * i + side, label, of_height, (len(at) > 0, some), first, height, flag, weight, totals
                )

    def count(term, side, table):
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        if side == _BOTH and not term:
            first, second, wa, sa = _folded(a, b, c, [np.int64, np.float64])
            orders, wb, sb = ([first], [second]), wa, sa
        elif side == _BOTH:
            first, second, wa, wb, sa, sb = _folded(a, b, c, [np.int64, np.int64, np.float64, np.float64])
            orders = [first], [second]
        else:
            first = _joined(a, np.float64 if side == _LEFT else np.uint16)
            second = _joined(b, np.float64)
            weight = _weights(table, [len(x) // 8 for x in b])
            if not term:
                wa = wb = weight
                sa = sb = weight * _joined(c, np.float64)
                orders = ([first, second], [second, first]) if side == _LEFT else ([first], [second])
            else:
                flag = _joined(c, np.uint8)
                wa, wb = np.where(flag == 0, weight, 0), np.where(flag == 1, weight, 0)
                sa, sb = wa * second, wb * second
                orders = ([first, flag] if side == _LEFT else [first]), [second, flag]
        n, sum_a, sum_b = inverted_pairs(*orders, wa, wb, sa, sb)
        difference = float(sum_a[0] - sum_b[0])
        if not term:
            return int(n[0]), aim * int(n[0]) - difference
        factor = bends[(term - 1) // 3][0]
        return 0, factor * difference if term % 3 == 1 else -factor * difference

    packed = _packed(pieces, key, ["ly", "ry", "theta", "w"], packets, PACK_ROWS // 4)
    # about nine rows a piece
    sums = _counted(packed, key, count, "crossings bigint, deviation double", 9 * total, chunk_rows)
    return sums.groupBy(*key).agg(
        F.sum("crossings").alias("crossings"), F.sum("deviation").alias("deviation")
    )
