"""A sketch of pairs looks only at those that can change it."""

import random

import numpy as np
import pytest

from lucidgraph.functions import sketch
from lucidgraph.operators import occlusion
from lucidgraph.operators.occlusion import node_occlusion_hll

from . import brute
from .conftest import by_trial


def registers_of_all(x, y, h, named, limit, bits):
    best = {}
    for i in range(len(x)):
        for j in range(i):
            close = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 < limit
            same = h[i] == h[j] and x[i] == x[j] and y[i] == y[j]
            if close and not same and (named[i] or named[j]):
                hashed = (int(h[i]) + int(h[j])) % 2**64
                at = int(sketch._mixed(np.array([hashed], dtype=np.uint64))[0]) >> (64 - bits)
                best[at] = max(best.get(at, 0), 65 - hashed.bit_length())
    return best


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_registers_are_those_of_all_pairs(monkeypatch, block):
    monkeypatch.setattr(sketch, "BLOCK", block)
    r = np.random.default_rng(3)
    x, y = r.random(150), r.random(150)
    h = r.integers(-(2**63), 2**63, 150)
    x[:4], y[:4], h[:3] = 0.5, 0.5, 77
    named = r.random(150) > 0.1
    want = registers_of_all(x, y, h, named, 0.2, 6)
    for zeros in (0, 1, 3, 6):
        at, rank = sketch.pair_registers(x, y, h, named, 0.2, zeros, 6)
        assert dict(zip(at.tolist(), rank.tolist())) == {k: v for k, v in want.items() if v > zeros}


def test_many_pairs_are_sketched_without_being_listed(make, monkeypatch):
    rng = random.Random(5)
    positions = {f"v{i}": (rng.random() * 3, rng.random() * 3) for i in range(700)}
    positions |= {f"w{i}": (1.25, 1.25) for i in range(9)}
    _, layout = make(positions, [], trials=(0, 4))
    far = make({"a": (0, 0), "b": (90, 0)}, [], trials=(9,))[1]
    want = len(brute.close_pairs(positions, 0.3))
    monkeypatch.setattr(occlusion, "LISTED_PAIRS", 0)
    monkeypatch.setattr(occlusion, "_close_id_pairs", lambda *_: pytest.fail("pairs are listed"))
    found = by_trial(node_occlusion_hll(layout.unionByName(far), 0.3, 0.1))
    assert found[0] == found[1] == pytest.approx(want, rel=0.3) and found[2] == 0
