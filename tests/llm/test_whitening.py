"""Whitening against numpy's eigenvectors and exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from filigree.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, component string, n string"


def vectors(seed=12, n=300, dims=20):
    r = np.random.default_rng(seed)
    scale = 10.0 ** np.linspace(1, -1.5, dims)
    mixed = r.normal(size=(n, dims)) * scale @ np.linalg.qr(r.normal(size=(dims, dims)))[0]
    return mixed.astype(np.float32).tolist()


def grid(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def test_whitening_equals_numpy(spark):
    good = vectors()
    good += good[:9] + [good[3]] * 20
    bad = [None, [], [None, *good[0][1:]], [float("nan"), *good[0][1:]], [float("-inf"), *good[0][1:]], good[0][:-1]]
    rows = [(i, v, None, "c", "n") for i, v in enumerate(good)] + [(None, good[5], 1, "c", "n")] + [(9000 + i, v, 1, "c", "n") for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS).repartition(5)).toPandas()
    x = np.array([grid(v) for v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    value, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    value, axes = value[::-1], axes[:, ::-1]
    assert len(got) == 16 * (len(good) + 1) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    z = (x - sums / n) @ axes[:, :16] / np.sqrt(value[:16])
    sign = {}
    for row in got.itertuples():
        i, c = (5 if math.isnan(row.vec_id) else int(row.vec_id)), row.component - 1
        sign.setdefault(c, np.sign(row.whitened * z[i, c]))
        assert row.whitened == pytest.approx(sign[c] * z[i, c], rel=1e-6, abs=1e-6)
        assert row.explained == pytest.approx(value[c] / value.sum(), rel=1e-9)
        assert row.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix: eigenvalues over 24 orders of magnitude, each to many digits."""
    r = np.random.default_rng(3)
    scale = 10.0 ** -np.arange(13)
    inner = np.eye(13) + 0.1 * (lambda m: (m + m.T) / 2)(r.normal(size=(13, 13)))
    value, axes = whitening.jacobi(scale[:, None] * inner * scale)
    exact = 1.0
    whole = [[Fraction(v) for v in row] for row in (scale[:, None] * inner * scale).tolist()]
    for i in range(13):  # the determinant by elimination in fractions
        exact *= float(whole[i][i])
        for j in range(i + 1, 13):
            f = whole[j][i] / whole[i][i]
            whole[j] = [a - f * b for a, b in zip(whole[j], whole[i])]
    assert np.prod(value) == pytest.approx(exact, rel=1e-10)
    assert np.abs(axes.T @ axes - np.eye(13)).max() < 1e-13
    assert (np.diff(value) <= 0).all()


@pytest.mark.parametrize("k", [1, 2, 3, 8, 33])
def test_jacobi_equals_eigh(k):
    m = np.random.default_rng(k).normal(size=(k, k))
    value, axes = whitening.jacobi(m @ m.T)
    assert value == pytest.approx(np.linalg.eigvalsh(m @ m.T)[::-1], rel=1e-8, abs=1e-12)
    assert np.abs(m @ m.T @ axes - axes * value).max() < 1e-10 * max(1, value[0])


def test_rounds_meet_every_pair_once():
    for k in (1, 2, 5, 8):
        pairs = [(int(a), int(b)) for p, q in whitening._rounds(k) for a, b in zip(p, q)]
        assert sorted(pairs) == [(i, j) for i in range(k) for j in range(i + 1, k)]


def test_without_variance_and_without_rows(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "", ""), (2, [1.0, 2.0], 0, "", "")], ROWS)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0], 0, "", "") for i in range(4)], ROWS)).toPandas()
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all() and flat.identity_error.max() < 1e-12
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []


def test_far_entries(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [1e30 if i else -1e30, float(i)], 0, "", "") for i in range(3)], ROWS)).toPandas()
    d = [(3 * v - 2**31) ** 2 for v in (-(2**31), 2**31, 2**31)]
    want = {i: v + (3 * 64 * i - 192) ** 2 for i, v in enumerate(d)}
    assert got[got.component == 1].set_index("vec_id").deviation.astype(object).map(lambda v: None if v != v else int(v)).to_dict() == {i: v if v < 2**63 else None for i, v in want.items()}
