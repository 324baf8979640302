"""The neighbour search against all distances."""

import numpy as np
import pytest

from filigree.plans import networks as N


def brute(x, y, k):
    out = []
    for i in range(len(x)):
        d = [(round(float(np.sqrt(sum((x[i, c] - y[j, c]) ** 2 for c in range(x.shape[1])))), 6), j) for j in range(len(y)) if j != i]
        out.append(sorted(d)[:k])
    return out


@pytest.mark.parametrize("shape", ["sphere", "far", "grid", "copies", "tiny"])
def test_near_pairs_hold_the_nearest(shape):
    r = np.random.default_rng(4)
    x = {"sphere": lambda: r.normal(size=(400, 8)), "far": lambda: 1e6 + r.normal(size=(400, 8)), "grid": lambda: r.integers(0, 3, (400, 3)).astype(float), "copies": lambda: np.repeat(r.normal(size=(4, 6)), 100, 0), "tiny": lambda: r.normal(size=(5, 3))}[shape]()
    ids = np.arange(len(x))
    u, v, d = N.near_pairs(ids, x, ids, x, 4)
    for i, want in enumerate(brute(x, x, 4)):
        assert sorted(zip([round(float(z), 6) for z in d[u == i]], v[u == i].tolist()))[:4] == want
    # Copies don't make a row's candidates grow.
    assert np.bincount(u).max() < 60


def test_no_row_of_a_block_is_compared_in_double_precision_with_all():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16))
    got = N.near_pairs(np.arange(3000), x, np.arange(3000), x, 4)
    assert len(got[0]) < 3 * 4 * 3000
    assert N.near_pairs(np.arange(2), x[:2], np.arange(1), np.full((1, 16), np.nan), 4)[0].size == 0


def test_search_in_blocks_is_the_search_in_one(spark):
    r = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(z) for z in r.normal(size=5)]) for i in range(90)], "id long, v array<float>")
    one, many = ({tuple(x) for x in N.nearest_vectors(v, 4, b).collect()} for b in (1, 4))
    assert one == many and len(one) == 360


@pytest.mark.parametrize("shape", ["sphere", "far", "grid", "copies", "huge", "mixed"])
def test_a_product_serves_both_vectors(shape):
    r = np.random.default_rng(5)
    make = {
        "sphere": lambda: r.normal(size=(300, 8)), "far": lambda: 1e6 + r.normal(size=(300, 8)), "grid": lambda: r.integers(0, 3, (300, 3)).astype(float),
        "copies": lambda: np.repeat(r.normal(size=(4, 6)), 75, 0), "huge": lambda: 1e25 * r.normal(size=(200, 4)), "mixed": lambda: np.concatenate([r.normal(size=(150, 5)), np.zeros((40, 5)), np.full((10, 5), np.nan), 1e4 * r.normal(size=(7, 5))]),
    }
    x = make[shape]()
    ids = r.permutation(len(x))
    order = np.argsort(ids)
    block = ids % 3
    bound = np.full(len(x), np.inf)
    for b in range(3):
        mine = block == b
        u, v, d = N.near_pairs(ids[mine], x[mine], ids[mine], x[mine], 4)
        for i in np.flatnonzero(mine):
            bound[i] = np.sort(d[u == ids[i]])[3] if (u == ids[i]).sum() > 3 else np.inf
    sides = [(ids[block == b], x[block == b], bound[block == b]) for b in range(3)]
    got = [N.near_both(sides[a], sides[b], 4) for a in range(3) for b in range(a, 3)]
    u, v, d = (np.concatenate(z) for z in zip(*got))
    fit = order[np.isfinite(x[order]).all(1)]
    want = brute(x[fit], x[fit], 4)
    assert set(u.tolist()) == set(ids[fit].tolist())
    for at, near in zip(fit, want):
        mine = u == ids[at]
        found = sorted(zip([round(float(z), 6) for z in d[mine]], v[mine].tolist()))[:4]
        assert [j for _, j in found] == [int(ids[fit[j]]) for _, j in near]
        assert [z for z, _ in found] == pytest.approx([z for z, _ in near], rel=1e-14)
    # Further copies are told of, not compared; at most k candidates and ties come out of each of a row's three cells.
    assert np.bincount(u).max() < 80


def test_search_in_parts_and_pairs_of_blocks_gives_few_candidates(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(z) for z in (r.normal(size=5) if i % 7 else np.ones(5))]) for i in range(700)], "id long, v array<float>")
    one, many = (sorted(tuple(x) for x in N.nearest_vectors(v, 4, *how).collect()) for how in ((1, 700), (5, 100)))
    assert one == many and len(one) == 2800
    cells = N.nearest_vectors(v, 4, 5, 100)._jdf.queryExecution().executedPlan().toString()
    assert cells.count("FlatMapGroupsInArrow") >= 2
