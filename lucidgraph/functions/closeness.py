"""Counting close pairs between two bounded sets of points, in numpy.

Both sets are halved along their wider side until few points are left.  Pairs of
equally small boxes go down together: all of their points are close, none are, or
both are halved again; only boxes of few points that the distance passes through
are compared point by point.
"""

from __future__ import annotations

import numpy as np

LEAF_ROWS = 256
# a box decides about its points only beyond what rounding could change
_SURE = 1e-9


class _Boxes:
    """Points in the order of a balanced tree of ``depth`` levels of halves."""

    def __init__(self, x, y, w, depth: int):
        order = np.arange(len(x))
        self.cuts = [np.array([0, len(x)])]
        for _ in range(depth):
            above = self.cuts[-1]
            cuts = np.empty(2 * len(above) - 1, dtype=np.int64)
            cuts[::2], cuts[1::2] = above, (above[:-1] + above[1:]) // 2
            for low, middle, high in zip(cuts[:-2:2], cuts[1::2], cuts[2::2]):
                if high - low > 1:
                    part = order[low:high]
                    px, py = x[part], y[part]
                    along = px if np.ptp(px) >= np.ptp(py) else py
                    order[low:high] = part[np.argpartition(along, middle - low)]
            self.cuts.append(cuts)
        self.x, self.y, self.w = x[order], y[order], w[order]
        self.weight = np.concatenate([[0], np.cumsum(self.w)])
        self.squares = np.concatenate([[0], np.cumsum(self.w * self.w)])
        self.unit = bool((w == 1).all())

    def sums(self, level: int, running: np.ndarray) -> np.ndarray:
        return np.diff(running[self.cuts[level]])

    def sides(self, level: int) -> tuple:
        """(least x, greatest x, least y, greatest y) of each box; empty ones hold nothing."""
        at = self.cuts[level]
        held = np.flatnonzero(np.diff(at) > 0)
        out = []
        for values in (self.x, self.y):
            for find, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
                side = np.full(len(at) - 1, none)
                side[held] = find.reduceat(values, at[held])
                out.append(side)
        return tuple(out)


def _bounds(p: tuple, q: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and the greatest distance of boxes."""
    near = far = 0.0
    for low, high in ((0, 1), (2, 3)):
        gap = np.maximum(np.maximum(q[low] - p[high], p[low] - q[high]), 0.0)
        span = np.maximum(q[high] - p[low], p[high] - q[low])
        near, far = near + gap * gap, far + span * span
    return near, far


def close_pairs(p, q, limit: float) -> int:
    """Weight of the pairs of a point of ``p`` and one of ``q`` whose squared distance is below
    ``limit``; each is (x, y, w).  With ``q`` None, of the pairs of different points of ``p``.

    Points that are not finite are close to none.
    """
    same = q is None

    def finite(points):
        x, y, w = (np.asarray(c) for c in points)
        known = np.isfinite(x) & np.isfinite(y)
        return (x, y, w) if known.all() else (x[known], y[known], w[known])

    p = finite(p)
    q = p if same else finite(q)
    most = max(len(p[0]), len(q[0]))
    if not len(p[0]) or not len(q[0]):
        return 0
    depth = max(0, (-(-most // LEAF_ROWS) - 1).bit_length())
    a = _Boxes(*p, depth)
    b = a if same else _Boxes(*q, depth)
    i = j = np.zeros(1, dtype=np.int64)
    total = 0
    with np.errstate(over="ignore"):
        for level in range(depth + 1):
            sides, others = a.sides(level), b.sides(level)
            near, far = _bounds([s[i] for s in sides], [s[j] for s in others])
            whole = far < limit * (1 - _SURE)
            wa, wb = a.sums(level, a.weight), b.sums(level, b.weight)
            apart = whole & (i != j) if same else whole
            total += int((wa[i[apart]] * wb[j[apart]]).sum())
            if same:
                own = i[whole & (i == j)]
                total += int(((wa[own] ** 2 - a.sums(level, a.squares)[own]) // 2).sum())
            open_ = ~whole & ~(near > limit * (1 + _SURE))
            i, j = i[open_], j[open_]
            if level < depth:
                i = np.concatenate([2 * i, 2 * i, 2 * i + 1, 2 * i + 1])
                j = np.concatenate([2 * j, 2 * j + 1, 2 * j, 2 * j + 1])
                if same:
                    i, j = i[i <= j], j[i <= j]
        for one, two in zip(i.tolist(), j.tolist()):
            total += _compared(a, b, one, two, limit, same and one == two)
    return total


def _compared(a: _Boxes, b: _Boxes, one: int, two: int, limit: float, own: bool) -> int:
    m, n = slice(*a.cuts[-1][one : one + 2]), slice(*b.cuts[-1][two : two + 2])
    dx = a.x[m, None] - b.x[n]
    dy = a.y[m, None] - b.y[n]
    dx *= dx
    dy *= dy
    dx += dy
    close = dx < limit
    if own:
        np.fill_diagonal(close, False)
    if a.unit and b.unit:
        found = int(np.count_nonzero(close))
    else:
        found = int(a.w[m] @ (close @ b.w[n]))
    return found // 2 if own else found
