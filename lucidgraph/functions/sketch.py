"""Registers of a HyperLogLog sketch over pairs, without a look at every pair.

The hash of a pair is the sum, modulo 2^64, of the hashes of its two members.  So in the
sorted hashes of a group the pairs whose hash begins with many zeros are found by searches.
A pair whose hash begins with fewer zeros than its register already has cannot change the
sketch; while every register has more than ``zeros``, the others need not be met.
"""

from __future__ import annotations

import numpy as np

# pairs that are held at once
BLOCK = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    """All bits of a hash spread over all others (the end of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _leading_zeros(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), dtype=np.int32)
    rest = h.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        small = rest < np.uint64(1 << (64 - shift))
        out += np.where(small, shift, 0)
        rest = np.where(small, rest << np.uint64(shift), rest)
    return np.where(h == 0, 64, out)


def pair_registers(x, y, h, named, limit: float, zeros: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(registers of 2^``bits``, greatest rank in each) of the pairs of points closer than the root
    of ``limit`` whose hash begins with ``zeros`` zeros at least; ranks are zeros plus one.

    Points of equal hash and place are one vertex, and two that are not ``named`` are no pair.
    """
    order = np.argsort(h.view(np.uint64), kind="stable")
    x, y, h, named = x[order], y[order], h.view(np.uint64)[order], named[order]
    n = len(h)
    best = np.zeros(1 << bits, dtype=np.int32)
    if zeros:
        first = np.uint64(0) - h
        last = first + np.uint64(1 << (64 - zeros))
        begin, end = np.searchsorted(h, first), np.searchsorted(h, last)
        count = np.where(first < last, end - begin, n - begin + end)
    else:
        begin, count = np.zeros(n, dtype=np.int64), np.full(n, n)
    sums = np.cumsum(count)
    row = 0
    while row < n:
        until = max(row + 1, int(np.searchsorted(sums, sums[row] - count[row] + BLOCK, side="right")))
        some = count[row:until]
        i = np.repeat(np.arange(row, until), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        j += begin[i]
        j[j >= n] -= n
        row = until
        # each pair comes from both of its ends
        once = i < j
        i, j = i[once], j[once]
        dx, dy = x[i] - x[j], y[i] - y[j]
        pair = (dx * dx + dy * dy < limit) & (named[i] | named[j])
        pair &= (h[i] != h[j]) | (dx != 0) | (dy != 0)
        hashed = h[i[pair]] + h[j[pair]]
        register = (_mixed(hashed) >> np.uint64(64 - bits)).astype(np.int64)
        np.maximum.at(best, register, _leading_zeros(hashed) + 1)
    found = np.flatnonzero(best)
    return found, best[found]
