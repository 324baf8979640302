"""The nearest observations against all distances."""

import random

import numpy as np
import pytest

from filigree.operators import weights as W


def brute(lengths, seen, k):
    out = {}
    for q in set(lengths):
        d = sorted((float(np.hypot(x - q, y)), x, y) for x, y in seen)
        out[q] = d[:k]
    return out


@pytest.mark.parametrize("shape", ["round", "flat", "far", "same"])
@pytest.mark.parametrize(("block", "visits", "k"), [(4096, 20_000, 50), (12, 3, 5)])
def test_nearest_are_exact_in_any_shape(spark, monkeypatch, shape, block, visits, k):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "VISITS", visits)
    r = random.Random(shape)
    point = {"round": lambda: (r.uniform(0, 30), r.uniform(-20, 20)), "flat": lambda: (r.uniform(0, 100), 1000 + r.random()), "far": lambda: (r.uniform(500, 510), r.uniform(0, 0.1)), "same": lambda: (float(r.randint(0, 3)), float(r.randint(1, 2)))}[shape]
    seen = [point() for _ in range(700)]
    lengths = [r.uniform(0, 60) for _ in range(40)] + [3.0, 3.0]
    got = W.nearest_observations(spark.createDataFrame([(x,) for x in lengths], "length double"), spark.createDataFrame(seen, "length double, weight double").repartition(3), k).collect()
    want = brute(lengths, seen, k)
    assert {g.length for g in got} == set(want)
    for g in got:
        assert [o.d for o in g.nearest] == pytest.approx([d for d, _, _ in want[g.length]], rel=1e-12)
        assert sorted((o.x, o.weight) for o in g.nearest) == sorted((x, y) for _, x, y in want[g.length])


def test_fewer_observations_than_asked_for(spark):
    got = W.nearest_observations(spark.createDataFrame([(1.0,)], "length double"), spark.createDataFrame([(2.0, 1.0), (0.0, 0.0)], "length double, weight double"), 50).first()
    assert [(o.x, o.weight) for o in got.nearest] == [(0.0, 0.0), (2.0, 1.0)]
