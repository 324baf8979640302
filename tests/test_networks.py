"""Frames, topology, components, paths and multifractal measures on graphs small enough to check by hand or brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigree import schema as S
from filigree.frame import NetworkFrame, canonical, from_edge_list, from_matrix, from_positions
from filigree.functions import geometry as G
from filigree.functions.numeric import nan_mean, py_round
from filigree.operators import components as C
from filigree.operators import kernels as K
from filigree.operators import multifractal as M
from filigree.operators import paths as P
from filigree.operators import ranking as R
from filigree.operators import topology as T
from filigree.operators import weights as W


def net(spark, n, edges, g="g", xy=None, weights=None):
    xy = xy or [(float(2 * i), float(2 * i + 1)) for i in range(n)]
    nodes = spark.createDataFrame([(g, i, *map(float, p)) for i, p in enumerate(xy)], S.NODES)
    e = spark.createDataFrame([(g, a, b, None if weights is None else float(weights[i])) for i, (a, b) in enumerate(edges)], S.EDGES)
    return NetworkFrame(nodes, e, weights is not None)


def chain(spark, n, **k):
    return net(spark, n, [(i, i + 1) for i in range(n - 1)], **k)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


CELLS = "graph_id string, u long, v long, weight double, edge_ix long"


def test_builders_differ_in_duplicates_and_loops(spark):
    nodes = chain(spark, 3).nodes
    cells = spark.createDataFrame([("g", 0, 1, 5.0, 0), ("g", 1, 0, 7.0, 1), ("g", 2, 2, 1.0, 2)], CELLS)
    assert values(from_matrix(nodes, cells).edges, "u", "v", "weight") == [(0, 1, 5.0)]
    assert values(canonical(cells, "last", loops=True), "u", "v", "weight") == [(0, 1, 7.0), (2, 2, 1.0)]
    assert values(from_edge_list(nodes, cells).edges, "u", "v") == [(0, 1), (2, 2)]
    segments = spark.createDataFrame([("g", 0.0, 1.0, 2.0, 3.0), ("g", 0.0, 1.0, 9.0, 9.0), ("g", 0.0, 1.0, 0.0, 1.0)], "graph_id string, x1 double, y1 double, x2 double, y2 double")
    assert values(from_positions(nodes, segments).edges, "u", "v") == [(0, 1)]


def test_weights(spark):
    c = chain(spark, 4, weights=[1, 2, 4])
    assert values(c.inverse_weights().edges, "weight") == [(0.25,), (0.5,), (1.0,)]
    assert values(T.degrees(c), "node_id", "degree", "strength") == [(0, 1, 1.0), (1, 2, 3.0), (2, 2, 6.0), (3, 1, 4.0)]
    pairs = spark.createDataFrame([("g", 1, 0), ("g", 0, 3)], "graph_id string, u long, v long")
    assert values(c.weight_of(pairs), "u", "v", "weight") == [(0, 3, 0.0), (1, 0, 1.0)]
    assert values(c.without_edges(pairs).edges, "u", "v") == [(1, 2), (2, 3)]
    assert c.make_weighted() is c and not c.make_unweighted().weighted
    with pytest.raises(Exception, match="non-positive weight"):
        chain(spark, 3, weights=[1, 0]).checked().edges.collect()
    moved = spark.createDataFrame([("g", 1, 9.0, 9.0)], S.NODES)
    assert values(c.with_positions(moved).nodes.where("node_id < 2"), "x", "y") == [(0.0, 1.0), (9.0, 9.0)]


def test_degree_statistics(spark):
    star = net(spark, 4, [(0, 1), (0, 2), (0, 3)], xy=[(0, 0), (1, 0), (0, 1), (-1, 0)])
    assert values(T.degree_distribution(star), "degree", "share") == [(1, 0.75), (3, 0.25)]
    assert values(T.degree_transitions(star), "degree_u", "degree_v", "prob") == [(1, 3, 1.0), (3, 1, 1.0)]
    assert sorted(round(r.gap) for r in T.angle_gaps(star).collect()) == [90, 90, 180]
    a = T.attributes(star).first()
    assert a.degree_distribution == {1: 0.75, 3: 0.25} and a.average_degree == 1.5 and a.average_length == 1.0
    assert a.degree_lengths == {1: [1.0] * 3, 3: [1.0] * 3}
    lone = T.attributes(net(spark, 1, [])).first()
    assert lone.average_degree == 0.0 and lone.average_length == 0.0
    assert T.assortativity(net(spark, 3, [(0, 1), (1, 2), (0, 2)])).first().assortativity == 0.0
    loop = net(spark, 2, [(0, 0), (0, 1)])
    assert values(T.degrees(loop), "node_id", "degree") == [(0, 3), (1, 1)]


def test_clustering(spark):
    k = net(spark, 4, [(0, 1), (1, 2), (0, 2), (2, 3)], weights=[1, 8, 8, 1])
    assert values(T.clustering(k), "node_id", "clustering") == [(0, 1.0), (1, 1.0), (2, pytest.approx(1 / 3)), (3, 0.0)]
    g = (1 * 8 * 8) ** (1 / 3) / 8
    assert values(T.clustering_onnela(k), "node_id", "clustering") == [(0, pytest.approx(g)), (1, pytest.approx(g)), (2, pytest.approx(g / 3)), (3, 0.0)]


def test_components_and_subgraphs(spark):
    d = net(spark, 5, [(0, 1), (1, 2), (3, 4)])
    assert values(C.components(d), "node_id", "label") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    r = C.connectivity(d).first()
    assert (r.n_components, r.lcc_share, r.top_sizes, r.connected) == (2, 0.6, [3, 2], False)
    assert values(C.largest_component(d).nodes, "node_id") == [(0,), (1,), (2,)]
    tie = net(spark, 4, [(2, 3), (0, 1)])
    assert values(C.largest_component(tie).nodes, "node_id") == [(0,), (1,)]
    keep = spark.createDataFrame([("g", 1), ("g", 2), ("g", 4)], "graph_id string, node_id long")
    assert values(T.induced(d, keep, renumber=True).edges, "u", "v") == [(0, 1)]
    long = chain(spark, 70)
    assert C.components(long).where("label <> 0").isEmpty()


def test_trim_meets_its_bound(spark):
    r = np.random.default_rng(3)
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 40, (160, 2)).tolist() if a != b} | {(i, i + 1) for i in range(39)})
    dense = net(spark, 40, edges)
    goal = spark.createDataFrame([("g", 2.0)], "graph_id string, target_degree double")
    t = T.counts(C.trim(dense, goal)).first()
    assert 2 * t.edge_count / t.node_count <= 2.2 + 1e-9
    once = values(T.trim_round(dense, goal).edges, "u", "v")
    deg = np.bincount(np.array(edges).ravel(), minlength=40)
    want = sorted(edges, key=lambda e: (max(deg[e[0]], deg[e[1]]), e))[: int(2.2 * 40 / 2)]
    assert once == sorted(want)


@pytest.mark.parametrize("how,want", [("none", (1.0, 2.0)), ("rot90", (3.0, 1.0)), ("rot180", (3.0, 3.0)), ("rot270", (2.0, 3.0)), ("transpose", (2.0, 1.0))])
def test_orientation(spark, how, want):
    n = net(spark, 3, [], xy=[(0, 0), (1, 2), (4, 5)])
    got = {r.node_id: (r.x, r.y) for r in T.oriented(n, how).nodes.collect()}
    assert got[1] == (want if how != "rot90" else (5 - 2.0, 1.0)) and T.oriented(n, how).nodes.count() == 3
    with pytest.raises(ValueError):
        G.orient(*[F.lit(0)] * 6, "sideways")


def test_frame_and_crop(spark):
    n = net(spark, 5, [(0, 1), (1, 2), (3, 4)], xy=[(0, 0), (1, 0), (2, 0), (50, 0), (-53, 0)])
    f = T.frame(n, 4, 2).first()
    assert (f.x0, f.x1, f.y0, f.y1) == (-2.0, 2.0, -1.0, 1.0)
    assert values(T.crop(n, T.frame(n, 4, 2)).edges, "u", "v") == [(0, 1), (1, 2)]


def brute_meets(p, q):
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    (a, b), (c, d) = p, q
    s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    return (s[0] != s[1] and s[2] != s[3]) or any(x == 0 and on(*y) for x, y in zip(s, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))))


def test_segments_and_grid_joins(spark):
    r = np.random.default_rng(4)
    xy = [tuple(map(float, p)) for p in r.integers(0, 12, (30, 2))]
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 30, (40, 2)).tolist() if a != b and xy[a] != xy[b]})
    n = net(spark, 30, edges, xy=xy)
    want = [(a, b, c, d) for (a, b), (c, d) in itertools.combinations(edges, 2) if not {a, b} & {c, d} and brute_meets((xy[a], xy[b]), (xy[c], xy[d]))]
    assert values(T.crossings(n, 3.0), "u1", "v1", "u2", "v2") == want
    near = [(a, b) for a, b in itertools.combinations(range(30), 2) if math.dist(xy[a], xy[b]) < 2.5]
    assert values(T.range_pairs(n.nodes, 2.5), "a", "b") == near
    best = [(i, min(math.dist(xy[i], xy[j]) for j in range(30) if j != i)) for i in range(30)]
    assert values(T.nearest_other(n.nodes, 0.4), "node_id", "distance") == [(i, pytest.approx(d)) for i, d in best]


def test_nearest_other_sends_no_table_through_the_driver(spark):
    nodes = net(spark, 3, [], xy=[(0.0, 0.0), (3.0, 4.0), (9.0, 4.0)]).nodes
    ring = T._ring(nodes, nodes, 5.0)
    assert "Broadcast" not in ring._jdf.queryExecution().executedPlan().toString()
    assert values(ring, "node_id", "distance") == [(0, 5.0), (1, 5.0), (2, 6.0)]


def test_rounding_as_python_does(spark):
    df = spark.createDataFrame([(2.675,), (0.25,), (2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(py_round(F.col("v"), 2)).collect()] == [2.67, 0.25, 2.5, None]
    assert [r[0] for r in df.select(py_round(F.col("v"), 0)).collect()] == [3.0, 0.0, 2.0, None]
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "v double")
    assert nan.select(nan_mean(F.col("v"))).first()[0] == 2.0
    assert math.isnan(nan.limit(0).select(nan_mean(F.col("v"))).first()[0])


def floyd(n, edges, w=None):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for i, (a, b) in enumerate(edges):
        d[a, b] = d[b, a] = min(d[a, b], 1.0 if w is None else w[i])
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


@pytest.fixture(scope="module")
def random_net():
    r = np.random.default_rng(7)
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 26, (36, 2)).tolist() if a != b})
    return 28, edges, [float(x) for x in r.integers(1, 9, len(edges)) / 2]


@pytest.mark.parametrize("weighted", [False, True])
def test_distances_closeness_betweenness(spark, random_net, weighted):
    n, edges, w = random_net
    d = floyd(n, edges, w if weighted else None)
    g = net(spark, n, edges, weights=w if weighted else None)
    got = {(r.src, r.dst): r.d for r in P.distances(g, weighted).collect()}
    assert got == {(i, j): d[i, j] for i in range(n) for j in range(n) if np.isfinite(d[i, j])}
    if not weighted:
        assert {(r.src, r.dst): r.d for r in P.hop_frontier(g).collect()} == got
    for r in P.closeness(g, weighted).collect():
        row = d[r.node_id][np.isfinite(d[r.node_id])]
        c, s = len(row), row.sum()
        assert r.closeness == pytest.approx((c - 1) / s * (c - 1) / (n - 1) if s else 0.0)
    length = dict(zip(edges, w)) if weighted else dict.fromkeys(edges, 1.0)
    length |= {(b, a): x for (a, b), x in length.items()}

    def paths(i, j):
        if i == j:
            return [[i]]
        return [[*p, j] for k in range(n) if (k, j) in length and np.isfinite(d[i, k]) and math.isclose(d[i, k] + length[k, j], d[i, j]) for p in paths(i, k)]

    want = np.zeros(n)
    for i, j in itertools.permutations(range(n), 2):
        if np.isfinite(d[i, j]):
            every = paths(i, j)
            for p in every:
                want[p[1:-1]] += 1 / len(every)
    for r in P.betweenness(g, weighted).collect():
        assert r.betweenness == pytest.approx(want[r.node_id] / ((n - 1) * (n - 2)))


def test_diameter_and_node_dimension(spark):
    assert P.diameter(chain(spark, 6, weights=[9] * 5)).first().diameter == 5.0
    d = {r.node_id: r.dimension for r in M.node_dimension(chain(spark, 6)).collect()}
    x, y = np.log([1, 2, 3, 4, 5]), np.log([2, 3, 4, 5, 6])
    assert d[0] == pytest.approx(np.polyfit(x, y, 1)[0])
    assert set(r.dimension for r in M.node_dimension(chain(spark, 3)).collect()) == {0.0}


def test_curvature_by_hand(spark):
    path = {(r.u, r.v): r.curvature for r in P.curvature(chain(spark, 3)).collect()}
    assert path == {(0, 1): pytest.approx(0.5), (1, 2): pytest.approx(0.5)}
    k4 = net(spark, 4, list(itertools.combinations(range(4), 2)))
    assert all(r.curvature == pytest.approx(2 / 3) for r in P.curvature(k4).collect())
    ring = net(spark, 6, [(i, (i + 1) % 6) for i in range(6)])
    assert all(r.curvature == pytest.approx(0, abs=1e-9) for r in P.curvature(ring).collect())


def test_transport_against_force():
    r = np.random.default_rng(2)
    for _ in range(25):
        m, n = r.integers(1, 4, 2)
        p, q = r.multinomial(6, np.ones(m) / m), r.multinomial(6, np.ones(n) / n)
        cost = r.integers(0, 7, (m, n)).astype(float)
        assert K.transport(p, q, cost) == pytest.approx(K.transport_by_force(p, q, cost))


def test_neighbour_masses_are_stable(spark):
    star = net(spark, 4, [(0, 1), (0, 2), (0, 3)], weights=[30, 40, 50])
    m = [r.mass for r in P.neighbour_masses(star).where("u = 0").collect()]
    assert sum(m) == pytest.approx(0.5) and max(m) == pytest.approx(0.5)
    star = net(spark, 4, [(0, 1), (0, 2), (0, 3)], weights=[0.4, 0.9, 1.3])
    e = np.exp(-np.array([0.4, 0.9, 1.3]) ** 2)
    assert values(P.neighbour_masses(star).where("u = 0"), "v", "mass") == [(i + 1, pytest.approx(0.5 * e[i] / e.sum())) for i in range(3)]


def test_eigenvector(spark):
    d = net(spark, 6, [(0, 1), (1, 2), (0, 2), (2, 3), (4, 5)])
    got = {r.node_id: r.eigenvector for r in P.eigenvector(d).collect()}
    a = np.zeros((4, 4))
    for i, j in [(0, 1), (1, 2), (0, 2), (2, 3)]:
        a[i, j] = a[j, i] = 1
    v = np.array([got[i] for i in range(4)])
    lam = v @ a @ v
    assert np.abs(a @ v - lam * v).max() < 1e-10 and got[4] is None and got[5] is None


def test_spectrum_structure(spark):
    n = 8
    grid = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j) for i in range(n - 1) for j in range(n)]
    g = net(spark, n * n, grid)
    b = P.balls(g)
    t = M.tau(b, M.NARROW)
    assert t.count() == 61
    by_q = {round(r.q, 1): r.tau for r in t.collect()}
    assert by_q[0.0] == pytest.approx(0, abs=1e-9) and all(by_q[round(-3 + k / 10, 1)] < by_q[round(-2.9 + k / 10, 1)] for k in range(60))
    s = sorted((r.q, r.alpha) for r in M.spectrum(t).collect())
    f = M.features(t).first()
    assert f.holder_exponent == pytest.approx(dict(s)[-0.1]) and f.other_branch == pytest.approx(dict(s)[0.0])
    assert f.spectrum_width == pytest.approx(max(a for _, a in s) - min(a for _, a in s))
    flat = M.tau(P.balls(chain(spark, 2)), 3)
    assert {r.tau for r in flat.collect()} == {0.0}


def test_metrics_distance_gates_and_ranks(spark):
    a = chain(spark, 6, g="a")
    b = net(spark, 6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)], g="b")
    ref = T.metrics(a)
    assert R.metric_distance(T.metrics(a), ref).first().distance == 0.0
    zero = spark.createDataFrame([("z", 0.0)], "graph_id string, m double")
    one = spark.createDataFrame([("o", 1.0)], "graph_id string, m double")
    assert R.metric_distance(one, zero, ("m",)).first().distance == 1.0
    both = NetworkFrame(a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges))
    r = R.ranking_report(T.metrics(both), ref).collect()
    assert [x["rank"] for x in r] == ["original", "1", "2"] and r[1].metric_distance == 0.0
    got = {x.graph_id: (x.error, x.passed) for x in R.checked(both, a, "length_angle", 1e-9).collect()}
    assert got["a"] == (0.0, True) and not got["b"][1]
    assert {x.passed for x in R.checked(both, a, "none", 0.0).collect()} == {True}
    strict = {x.graph_id: x.passed for x in R.checked(both, a, "multifractal", 0.0).collect()}
    assert strict["a"] is False
    with pytest.raises(ValueError):
        R.gate("other")


def test_robust_mean(spark):
    e = [0.9, 0.95, 1.0, 1.0, 1.0, 1.0, 1.0, 1.05, 1.1, 1.0, 100.0, float("inf")]
    df = spark.createDataFrame([("t", x) for x in e] + [("u", float("inf")), ("v", 0.1234)], "trial string, error double")
    assert {r.trial: r.error for r in R.robust_mean(df, "trial").collect()} == {"t": 1.0, "u": float("inf"), "v": 0.123}


def test_pareto_and_scores(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.integers(0, 12, (80, 2)))]
    df = spark.createDataFrame(rows, "i long, error double, success_rate double")
    want = [i for i, e, s in rows if not any(f <= e and t >= s and (f < e or t > s) for _, f, t in rows)]
    assert [x[0] for x in values(R.pareto(df), "i")] == want
    s = {x.i: x.score for x in R.combined_score(df).collect()}
    assert max(s.values()) <= 1 and min(s.values()) >= 0
    assert R.factor_grid(df, 0.3, 2.0, 0.1).count() == 324


@pytest.mark.parametrize("n", [40, 400])
def test_weight_bins(spark, n):
    r = np.random.default_rng(n)
    xy = [tuple(p) for p in r.random((n + 1, 2)) * 100]
    c = chain(spark, n + 1, xy=xy, weights=list(r.random(n) + 0.5))
    model = W.fit(c).collect()
    assert len(model) == 100 and sum(len(m.weights) for m in model) == n
    lengths = sorted(math.dist(xy[i], xy[i + 1]) for i in range(n))
    lo = {m.bin: m.lo for m in model}
    if n > 100:
        assert lo[50] == pytest.approx(lengths[n // 3]) and lo[80] == pytest.approx(lengths[2 * n // 3])
    seen = {m.bin: m.weights for m in model}
    drawn = W.assign(c.make_unweighted(), W.fit(c), 3)
    bins = {(x.u, x.v): x.bin for x in W.assign_bins(T.placed_edges(c).select("graph_id", "u", "v", "length"), W.length_bins(T.placed_edges(c).select("graph_id", "length"))).collect()}
    assert all(x.weight in seen[bins[x.u, x.v]] for x in drawn.edges.collect())
    assert W.assign_mixed(c.make_unweighted(), c, seed=3).edges.where("weight is null").isEmpty()


@pytest.mark.parametrize("local", [0, 1, 2_000_000])
def test_components_by_tasks_and_by_joins_agree(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    r = random.Random(3)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(120, 150)]
    n = net(spark, 160, edges)
    want = {i: i for i in range(160)}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(want[a], want[b])
            moved |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert {x.node_id: x.label for x in C.components(n).collect()} == want


@pytest.mark.parametrize("target", [1.2, 1.6, 2.4, 9.0])
def test_trimming_in_tasks_and_by_joins_agrees(spark, monkeypatch, target):
    import random

    r = random.Random(5)
    edges = sorted({tuple(sorted((r.randrange(40), r.randrange(40)))) for _ in range(110)})
    n = net(spark, 42, [e for e in edges if e[0] != e[1]], weights=[1 + i for i in range(len([e for e in edges if e[0] != e[1]]))])
    goal = spark.createDataFrame([("g", target)], "graph_id string, target_degree double")
    got = []
    for local in (2_000_000, 0):
        monkeypatch.setattr(C, "LOCAL_EDGES", local)
        t = C.trim(n, goal)
        got.append((values(t.nodes, "node_id", "x", "y"), values(t.edges, "u", "v", "weight")))
    assert got[0] == got[1] and 2 * len(got[0][1]) / len(got[0][0]) <= 1.1 * target


def test_chunks_of_sources_fold(spark):
    n = chain(spark, 9)
    whole = {x.node_id: x.betweenness for x in P.betweenness(n).collect()}
    work = lambda g, graph, sources: pd.DataFrame({"graph_id": g, "node_id": graph.ids[sources], "n": graph.n})
    got = P.on_sources(n, work, "graph_id string, node_id long, n long", chunk=2, most=2).collect()
    assert sorted(x.node_id for x in got) == list(range(9)) and {x.n for x in got} == {9}
    assert whole[4] == pytest.approx(16 / 28) and whole[0] == 0


def test_populations_are_bounded(spark):
    df = spark.range(10_000).select(F.lit("g").alias("graph_id"), F.lit(2).alias("degree"), F.col("id").cast("double").alias("length"))
    [few] = T.population(df.where("length < 50"), "length", "lengths", 64).collect()
    [many] = T.population(df, "length", "lengths", 64).collect()
    assert few.lengths == [float(i) for i in range(50)] and len(many.lengths) == 64
    assert all(abs(x - (i + 0.5) * 10_000 / 64) < 40 for i, x in enumerate(many.lengths))
