"""Counting inverted pairs of one bounded chunk, in numpy.

Rows are laid out in their first order and given their rank in the second; a
pair is inverted if the earlier row has the higher rank.  Two ranks differ in a
unique highest bit, so one pass per bit over the rows, kept in first order
inside groups of equal higher bits, meets each inverted pair once: the earlier
row has the bit, the later one has not.

More than ``BLOCK`` rows are halved first, and pairs between two halves are told by a
search in the sorted earlier one.  So the passes, which hold a dozen numbers a row, never
see more than a block, and totals need few bytes a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows that the passes go over at once.
BLOCK = 1 << 16


def ranks_of(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank


def _running(values: np.ndarray, dtype) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=dtype)
    np.cumsum(values, out=out[1:])
    return out


class _Passes:
    """The passes over a permutation, highest bit first.

    Each pass sets ``low`` (rows without the bit), ``start`` (where the group
    of a row begins) and ``before`` (rows of the group with the bit so far).
    """

    def __init__(self, rank: np.ndarray):
        self.n = len(rank)
        self.ranks = rank.astype(np.int32)
        self.here = np.arange(self.n, dtype=np.int32)

    def __iter__(self):
        for bit in range(max(self.n - 1, 0).bit_length() - 1, -1, -1):
            high = (self.ranks >> bit) & 1
            self.bit = bit
            self.low = high == 0
            self.start = (self.ranks >> (bit + 1)) << (bit + 1)
            running = _running(high, np.int32)
            self.before = running[:-1] - running[self.start]
            yield self

    def split(self, *arrays: np.ndarray) -> list[np.ndarray]:
        """Stable split of every group into its low and its high half."""
        target = np.where(
            self.low,
            self.here - self.before,
            np.minimum(self.start + (1 << self.bit), self.n) + self.before,
        )
        moved = []
        for values in (self.ranks, *arrays):
            out = np.empty_like(values)
            out[target] = values
            moved.append(out)
        self.ranks = moved[0]
        return moved[1:]


def _halves(rank: np.ndarray):
    """(begin, end, None) of each block, (begin, middle, end) of each two halves."""
    todo = [(0, len(rank))]
    while todo:
        begin, end = todo.pop()
        if end - begin <= BLOCK:
            yield begin, end, None
        else:
            middle = (begin + end) // 2
            todo += [(begin, middle), (middle, end)]
            yield begin, middle, end


def _dense(rank: np.ndarray) -> np.ndarray:
    """The order of ``rank`` as a permutation of its own."""
    return ranks_of(np.argsort(rank))


def count_inversions(rank: np.ndarray) -> int:
    """Number of inverted pairs of a permutation."""
    total = 0
    for begin, middle, end in _halves(rank):
        if end is None:
            whole = begin == 0 and middle == len(rank)
            passes = _Passes(rank if whole else _dense(rank[begin:middle]))
            for step in passes:
                total += int(step.before[step.low].sum(dtype=np.int64))
                step.split()
        else:
            below = np.searchsorted(np.sort(rank[begin:middle]), rank[middle:end])
            total += (middle - begin) * (end - middle) - int(below.sum(dtype=np.int64))
    return total


def inversion_totals(rank: np.ndarray, column: Callable) -> tuple:
    """Over inverted pairs (a, b), a earlier: the sums of wa*wb, sa*wb and wa*sb.

    ``column(name, begin, end)`` gives the rows from ``begin`` to ``end`` of ``"wa"``, ``"wb"``,
    ``"sa"`` or ``"sb"``; only those of one half are held at a time.
    """
    count, sum_a, sum_b = 0, 0.0, 0.0
    for begin, middle, end in _halves(rank):
        if end is None:
            rows = begin, middle
            wb = column("wb", *rows)
            later, earlier = inversion_weights(_dense(rank[begin:middle]), column("wa", *rows), wb)
            wide = earlier.astype(np.result_type(wb.dtype, np.int64))
            count += (wb * wide).sum().item()
            sum_a += float((column("sa", *rows) * later).sum())
            sum_b += float((column("sb", *rows) * earlier).sum())
            continue
        order = np.argsort(rank[begin:middle])
        below = np.searchsorted(rank[begin:middle][order], rank[middle:end])

        def above(name):
            """Per row of the later half, the sum over those of the earlier one that rank higher."""
            values = column(name, begin, middle)[order]
            running = _running(values, np.result_type(values.dtype, np.int64))
            return running[-1] - running[below]

        weight = above("wa")
        count += (column("wb", middle, end) * weight).sum().item()
        sum_b += float((column("sb", middle, end) * weight).sum())
        del weight
        sum_a += float((column("wb", middle, end) * above("sa")).sum())
    return count, sum_a, sum_b


def inversion_weights(rank, wa, wb) -> tuple[np.ndarray, np.ndarray]:
    """Per row: (sum of wb over its inverted later rows, sum of wa over earlier ones)."""
    n = len(rank)
    small = wa.dtype.kind in "iu" and max(int(wa.sum()), int(wb.sum())) < 2**31
    work = np.int32 if small else np.result_type(wa.dtype, wb.dtype, np.int64)
    wa, wb = wa.astype(work), wb.astype(work)
    later = np.zeros(n, dtype=work)
    earlier = np.zeros(n, dtype=work)
    rows = np.arange(n, dtype=np.int32)
    passes = _Passes(rank)
    for step in passes:
        low, start = step.low, step.start
        seen_a = _running(np.where(low, 0, wa), work)
        seen_b = _running(np.where(low, wb, 0), work)
        end = np.minimum(start + (2 << step.bit), n)
        earlier += np.where(low, seen_a[:-1] - seen_a[start], 0)
        later += np.where(low, 0, seen_b[end] - seen_b[1:])
        wa, wb, later, earlier, rows = step.split(wa, wb, later, earlier, rows)
    out_later, out_earlier = np.empty_like(later), np.empty_like(earlier)
    out_later[rows], out_earlier[rows] = later, earlier
    return out_later, out_earlier


def inverted_pairs(first, second, wa, wb, sa=None, sb=None, group=None, groups=1):
    """Totals over pairs (a, b): a before b by ``first``, after b by ``second``.

    ``first`` and ``second`` are lists of arrays, most significant first; both
    comparisons are strict.  Returns ``sum(wa*wb)`` and, if ``sa``/``sb`` are
    given, ``sum(sa*wb)`` and ``sum(wa*sb)``; each an array over the ``groups``
    that ``group`` numbers (pairs never span groups when the group leads both
    orders).
    """
    first, second = list(first), list(second)
    # ties in one order are laid out by the other, and so never look inverted
    known = {id(k) for k in first}
    order = np.lexsort([*first, *(k for k in second if id(k) not in known)][::-1]).astype(np.int32)
    place = ranks_of(order)
    rank = ranks_of(np.lexsort([place, *second[::-1]]))[order]
    del place
    wa, wb = np.asarray(wa), np.asarray(wb)
    if group is None:
        if sa is None and (wa == 1).all() and (wb == 1).all():
            return np.array([count_inversions(rank)]), np.zeros(1), np.zeros(1)
        none = np.broadcast_to(0.0, len(order))
        values = {"wa": wa, "wb": wb, "sa": none if sa is None else sa, "sb": none if sb is None else sb}
        totals = inversion_totals(
            rank, lambda name, begin, end: np.asarray(values[name])[order[begin:end]]
        )
        return tuple(np.array([t]) for t in totals)
    wa, wb = wa[order], wb[order]
    later, earlier = inversion_weights(rank, wa, wb)
    at = np.asarray(group)[order]

    def total(values):
        return np.bincount(at, weights=values, minlength=groups)

    count = total(wb * earlier.astype(np.result_type(wb.dtype, np.int64)))
    if wa.dtype.kind in "iu":
        count = np.rint(count).astype(np.int64)
    if sa is None:
        return count, np.zeros(groups), np.zeros(groups)
    return count, total(np.asarray(sa)[order] * later), total(np.asarray(sb)[order] * earlier)
