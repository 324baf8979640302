"""Queries whose output is pairs: nothing is gathered again behind them, and they leave Python as arrays."""

import itertools
import math

import numpy as np
import pytest

from filigree.frame import NetworkFrame
from filigree.operators import paths
from filigree.operators import topology as T

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, u long, v long, weight double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def turned(a, b, c):
    return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


@pytest.mark.parametrize("pairs", [1, 50, 1 << 26])
def test_every_crossing_is_found_in_one_cell_alone(spark, monkeypatch, pairs):
    monkeypatch.setattr(T, "CELL_PAIRS", pairs)
    r = np.random.default_rng(9)
    xy = [tuple(map(float, p)) for p in r.random((40, 2)) * 5 - 2]
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 40, (70, 2)).tolist() if a != b})
    nodes = spark.createDataFrame([("g", i, *p) for i, p in enumerate(xy)], NODES)
    net = NetworkFrame(nodes, spark.createDataFrame([("g", a, b, None) for a, b in [*edges, edges[0]]], EDGES))
    meet = lambda a, b, c, d: turned(a, b, c) != turned(a, b, d) and turned(c, d, a) != turned(c, d, b)
    want = [(*p, *q) for p, q in itertools.combinations(edges, 2) if not {*p} & {*q} and meet(*(xy[k] for k in (*p, *q)))]
    got = T.crossings(net, 0.7)
    assert sorted(tuple(r)[1:] for r in got.collect()) == want and len(want) > 100
    assert "Aggregate" not in plan(got)


def test_hop_distances_leave_as_arrays(spark):
    nodes = spark.createDataFrame([("g", i, 0.0, 0.0) for i in range(9)] + [("one", 4, 0.0, 0.0)], NODES)
    net = NetworkFrame(nodes, spark.createDataFrame([("g", i, i + 1, None) for i in (0, 1, 2, 5, 6)], EDGES))
    got = paths.distances(net)
    parts = [(0, 4), (4, 5), (5, 8), (8, 9)]
    want = sorted([("g", a, b, float(abs(a - b))) for lo, hi in parts for a in range(lo, hi) for b in range(lo, hi)] + [("one", 4, 4, 0.0)])
    assert sorted(map(tuple, got.collect())) == want and not any(math.isinf(r.d) for r in got.collect())
    assert "posexplode" in plan(got)
