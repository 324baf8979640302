"""Kernels by bits and by levels against plain searches."""

import time

import numpy as np
import pytest

from filigree.operators import kernels as K


def graph(n, m, seed=0):
    r = np.random.default_rng(seed)
    return K.Csr(np.arange(n), r.integers(0, n, m), r.integers(0, n, m))


@pytest.mark.parametrize(("n", "m"), [(200, 150), (200, 500), (50, 0), (1, 0), (70, 3000)])
def test_hop_counts_and_levels(n, m, monkeypatch):
    monkeypatch.setattr(K, "GATHER", 64)
    g = graph(n, m)
    sources = np.arange(0, n, 2)
    d, c = K.hops(g, sources), K.hop_counts(g, sources)
    assert (K.hop_levels(g, sources) == np.where(np.isfinite(d), d, -1)).all()
    assert all((c[:, k] == (d == k + 1).sum(1)).all() for k in range(c.shape[1])) and c.sum() == (np.isfinite(d) & (d > 0)).sum()
    assert K.hop_counts(g, sources, 2).sum() == (d == 1).sum()


def test_balls_of_many_sources_cost_a_fraction_of_their_distances():
    g, sources = graph(20_000, 60_000), np.arange(64)
    t = time.process_time()
    K.hops(g, sources)
    plain = time.process_time() - t
    t = time.process_time()
    K.hop_counts(g, sources)
    assert 4 * (time.process_time() - t) < plain


def test_dependencies_by_levels():
    g = graph(60, 90)
    total = np.zeros(g.n)
    d = K.hops(g, np.arange(g.n))
    arcs = [(a, b) for a in range(g.n) for b in g.neighbours(a).tolist()]
    for s in range(g.n):
        sigma, delta = np.zeros(g.n), np.zeros(g.n)
        sigma[s] = 1.0
        tight = sorted(((d[s, a], a, b) for a, b in arcs if np.isfinite(d[s, a]) and d[s, a] + 1 == d[s, b]))
        for _, a, b in tight:
            sigma[b] += sigma[a]
        for _, a, b in reversed(tight):
            delta[a] += sigma[a] / sigma[b] * (1 + delta[b])
        delta[s] = 0.0
        total += delta
    assert K.dependencies(g, np.arange(g.n), False) == pytest.approx(total)


def test_masses_that_rounding_leaves_don_t_move_for_ever():
    """Forty entries of 5e-14 are more than the tolerance together, none of them alone."""
    p = np.full(40, 5e-14)
    assert K.transport(p, p, np.ones((40, 40))) == pytest.approx(0.0, abs=1e-11)


def test_principal_vector_of_values_that_lie_close():
    """Two dense parts that a long path joins: their values differ by 4e-4, and power iteration had not settled after 200,000 rounds."""
    r = np.random.default_rng(3)
    part = lambda at: (at + r.integers(0, 60, 300), at + r.integers(0, 60, 300))
    (a, b), line = part(0), np.arange(59, 68)
    u, v = np.concatenate([a, a + 68, line, [1]]), np.concatenate([b, b + 68, line + 1, [200]])
    g = K.Csr(np.concatenate([np.arange(128), [200]]), u, v)
    full = np.zeros((g.n, g.n))
    np.add.at(full, (np.repeat(np.arange(g.n), g.degree), g.dst), 1.0)
    value, vector = np.linalg.eigh(full)
    assert 0 < value[-1] - value[-2] < 1e-2
    assert K.principal_vector(g, False, rounds=400) == pytest.approx(np.abs(vector[:, -1]), abs=1e-9)


@pytest.mark.parametrize("edges", [[], [(0, 1)], [(0, 1), (1, 2), (2, 3), (3, 0)], [(0, k) for k in range(1, 9)]])
def test_principal_vector_of_small_graphs(edges):
    n = 1 + max((max(e) for e in edges), default=0)
    g = K.Csr(np.arange(n), *np.array(edges, int).reshape(-1, 2).T)
    full = np.zeros((n, n))
    for a, b in edges:
        full[a, b] = full[b, a] = 1
    assert K.principal_vector(g, True) == pytest.approx(np.abs(np.linalg.eigh(full)[1][:, -1]), abs=1e-12)
