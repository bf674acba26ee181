"""Definitions in plain Python, for small fixtures."""

import math


def _side(a, b, c):
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def crossings(positions, edges):
    """(proper crossings, pairs with a common point)."""
    lines = [(positions[s], positions[d]) for s, d in edges]
    proper = meeting = 0
    for i, (a, b) in enumerate(lines):
        for c, d in lines[:i]:
            s1 = _side(a, b, c) * _side(a, b, d)
            s2 = _side(c, d, a) * _side(c, d, b)
            proper += s1 < 0 and s2 < 0
            if s1 == 0 and s2 == 0:
                (al, ah), (cl, ch) = sorted((a, b)), sorted((c, d))
                meeting += cl <= ah and al <= ch
            else:
                meeting += s1 <= 0 and s2 <= 0
    return proper, meeting


def segments(positions, edges, g):
    out = []
    for s, d in edges:
        (xl, yl), (xr, yr) = sorted((positions[s], positions[d]))
        if xl == xr:
            continue
        for i in range(math.ceil(xl / g), math.floor(xr / g)):
            left, right = (
                yr if x == xr else yl + (yr - yl) * (x - xl) / (xr - xl)
                for x in (i * g, (i + 1) * g)
            )
            out.append((i, left, right, math.atan2(yr - yl, xr - xl)))
    return out


def strip_crossings(positions, edges, g, ideal=70.0):
    """(crossings in strips, mean deviation of their angles or None)."""
    aim = math.radians(ideal)
    pieces = segments(positions, edges, g)
    count, total = 0, 0.0
    for i, la, ra, ta in pieces:
        for j, lb, rb, tb in pieces:
            if i == j and la < lb and ra > rb:
                delta = abs(ta - tb)
                count += 1
                total += abs(aim - min(delta, math.pi - delta))
    return count, total / (count * aim) if count else None


def close_pairs(positions, r):
    ids = sorted(positions)
    return {
        (u, v)
        for i, u in enumerate(ids)
        for v in ids[i + 1 :]
        if (positions[u][0] - positions[v][0]) ** 2 + (positions[u][1] - positions[v][1]) ** 2
        < (2 * r) * (2 * r)
    }


def repulsion(positions, k, m=2.0):
    out = {}
    for u, (x, y) in positions.items():
        fx = fy = 0.0
        for v, (a, b) in positions.items():
            d2 = (x - a) ** 2 + (y - b) ** 2
            if u != v and d2 > 0:
                fx += m * k * k * (x - a) / d2
                fy += m * k * k * (y - b) / d2
        out[u] = (fx, fy)
    return out
