"""The numpy kernels against their definitions."""

import math
import tracemalloc

import numpy as np
import pytest

from lucidgraph.functions import inversions
from lucidgraph.functions.closeness import close_pairs
from lucidgraph.functions.hinges import deviation_totals
from lucidgraph.functions.inversions import inverted_pairs


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 60, 150])
@pytest.mark.parametrize("spread", [3, 20, 10**6])
@pytest.mark.parametrize("unit", [False, True])
def test_inverted_pairs(n, spread, unit):
    rng = np.random.default_rng(n + spread)
    a, b, c, d = (rng.integers(0, spread, n) for _ in range(4))
    group = rng.integers(0, 4, n)
    wa = np.ones(n, dtype=int) if unit else rng.integers(0, 4, n)
    wb = np.ones(n, dtype=int) if unit else rng.integers(0, 4, n)
    sa, sb = rng.random(n), rng.random(n)
    count, total_a, total_b = np.zeros(4), np.zeros(4), np.zeros(4)
    for j in range(n):
        for i in range(n):
            earlier = (a[i], b[i]) < (a[j], b[j]) and (c[i], d[i]) > (c[j], d[j])
            if earlier and group[i] == group[j]:
                count[group[j]] += wa[i] * wb[j]
                total_a[group[j]] += sa[i] * wb[j]
                total_b[group[j]] += wa[i] * sb[j]
    got = inverted_pairs([group, a, b], [group, c, d], wa, wb, sa, sb, group, 4)
    assert got[0].tolist() == count.tolist()
    assert np.allclose(got[1], total_a) and np.allclose(got[2], total_b)
    plain = inverted_pairs([group, a, b], [group, c, d], wa, wb)
    assert plain[0].tolist() == [count.sum()]


@pytest.mark.parametrize("ideal", [10, 45, 70, 90])
@pytest.mark.parametrize("n", [1, 2, 40, 120])
def test_deviation_totals(n, ideal):
    rng = np.random.default_rng(n * ideal)
    ly = rng.integers(0, 12, n) * 1.0
    ry = ly + rng.integers(-20, 20, n)
    theta, w = np.arctan2(ry - ly, 1.0), rng.integers(1, 3, n)
    aim, count, total = math.radians(ideal), 0, 0.0
    for i in range(n):
        for j in range(n):
            if ly[i] < ly[j] and ry[i] > ry[j]:
                delta = theta[i] - theta[j]
                count += w[i] * w[j]
                total += w[i] * w[j] * abs(aim - min(delta, math.pi - delta))
    got = deviation_totals(ly, ry, theta, w, aim)
    assert got[0] == count
    assert got[1] == pytest.approx(total, abs=1e-8)


def _segments(n):
    rng = np.random.default_rng(n)
    ly = rng.random(n) * 100
    theta = rng.random(n) * 3 - 1.5
    return ly, ly + np.tan(theta), theta, rng.integers(1, 3, n)


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_totals_do_not_depend_on_blocks(monkeypatch, block):
    ly, ry, theta, w = _segments(300)
    ly[::5] = ly[0]  # ties
    whole = deviation_totals(ly, ry, theta, w, 1.2), inverted_pairs([ly], [ry], w, w, w * ly, w * ry)
    count = inverted_pairs([ly], [ry], np.ones(300, int), np.ones(300, int))[0].tolist()
    monkeypatch.setattr(inversions, "BLOCK", block)
    crossings, deviation = deviation_totals(ly, ry, theta, w, 1.2)
    assert (crossings, deviation) == (whole[0][0], pytest.approx(whole[0][1], rel=1e-10))
    got = inverted_pairs([ly], [ry], w, w, w * ly, w * ry)
    assert got[0].tolist() == whole[1][0].tolist()
    assert np.allclose(got[1], whole[1][1]) and np.allclose(got[2], whole[1][2])
    assert inverted_pairs([ly], [ry], np.ones(300, int), np.ones(300, int))[0].tolist() == count


def test_angles_of_a_strip_take_few_bytes_a_segment():
    n = 300_000
    columns = _segments(n)
    tracemalloc.start()
    try:
        deviation_totals(*columns, math.radians(70))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the columns in another order are 32 of them
    assert peak < 160 * n


@pytest.mark.parametrize("n, m", [(0, 5), (1, 1), (40, 3), (900, 700)])
@pytest.mark.parametrize("limit", [0.0, 0.02, 0.5, 30.0])
@pytest.mark.parametrize("heavy", [1, 4])
def test_close_pairs(n, m, limit, heavy):
    rng = np.random.default_rng(n + m)
    # a crowd, points on a lattice whose distances tie with the limit, and one at infinity
    p = (rng.integers(0, 8, n) / 4, rng.random(n) ** 4, rng.integers(1, heavy + 1, n))
    q = (rng.integers(0, 8, m) / 4 + 0.5, rng.random(m), rng.integers(1, heavy + 1, m))
    p[0][:1] = np.inf

    def close(a, b):
        with np.errstate(invalid="ignore"):
            return (a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2 < limit

    assert close_pairs(p, q, limit) == p[2] @ close(p, q) @ q[2]
    assert close_pairs(p, None, limit) == p[2] @ np.triu(close(p, p), 1) @ p[2]
