"""Column expressions shared by the operators.  No UDFs here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(id_: Column, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on (id, seed) only.

    The first 32 bits of an md5 digest: the same on every engine, for any
    partitioning, and on every recomputation of a lost task.
    """
    digest = F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(squared_distance(ax, ay, bx, by))


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of (a, b, c); exactly 0 when c equals a or b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _not_after(ax, ay, bx, by) -> Column:
    return (ax < bx) | ((ax == bx) & (ay <= by))


def segments_intersect(a, b, c, d, proper: bool = False) -> Column:
    """Does segment a-b meet segment c-d?  Each argument is an (x, y) pair.

    Touching and collinear overlap count; ``proper=True`` keeps only crossings
    in the interior of both.
    """
    o1, o2 = orientation(*a, *b, *c), orientation(*a, *b, *d)
    o3, o4 = orientation(*c, *d, *a), orientation(*c, *d, *b)
    s1, s2 = F.signum(o1) * F.signum(o2), F.signum(o3) * F.signum(o4)
    if proper:
        return (s1 < 0) & (s2 < 0)

    def ordered(p, q):
        first = _not_after(*p, *q)
        low = tuple(F.when(first, u).otherwise(v) for u, v in zip(p, q))
        high = tuple(F.when(first, v).otherwise(u) for u, v in zip(p, q))
        return low, high

    (al, ah), (cl, ch) = ordered(a, b), ordered(c, d)
    overlap = _not_after(*cl, *ah) & _not_after(*al, *ch)
    return F.when((s1 == 0) & (s2 == 0), overlap).otherwise((s1 <= 0) & (s2 <= 0))


def left_to_right(x1="x1", y1="y1", x2="x2", y2="y2") -> list[Column]:
    """The end points of an edge as xl, yl, xr, yr with (xl, yl) <= (xr, yr)."""
    a, b, c, d = F.col(x1), F.col(y1), F.col(x2), F.col(y2)
    keep = _not_after(a, b, c, d)
    return [
        F.when(keep, a).otherwise(c).alias("xl"),
        F.when(keep, b).otherwise(d).alias("yl"),
        F.when(keep, c).otherwise(a).alias("xr"),
        F.when(keep, d).otherwise(b).alias("yr"),
    ]


def height_at(x: Column) -> Column:
    """y of the edge (xl, yl)-(xr, yr) at ``x``; the stored y at both ends."""
    xl, yl, xr, yr = (F.col(c) for c in ("xl", "yl", "xr", "yr"))
    return F.when(x == xr, yr).otherwise(yl + (yr - yl) * (x - xl) / (xr - xl))


def slope_angle() -> Column:
    """Angle of a non-vertical edge against the x axis, in (-pi/2, pi/2)."""
    return F.atan2(F.col("yr") - F.col("yl"), F.col("xr") - F.col("xl"))


def acute_angle(theta_a: Column, theta_b: Column) -> Column:
    delta = F.abs(theta_a - theta_b)
    return F.least(delta, F.lit(math.pi) - delta)


def floor_div(value: Column, size) -> Column:
    return F.floor(value / F.lit(float(size))).cast("bigint")
