"""What leaves a query or passes between its steps takes little room."""

import itertools
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from filigree.frame import NetworkFrame
from filigree.operators import kernels as K
from filigree.operators import large, paths

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, u long, v long, weight double"


def drawn(spark, n, k=3, seed=4):
    r = np.random.default_rng(seed)
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, n, (k * n, 2)).tolist() if a != b})
    return NetworkFrame(spark.createDataFrame([("g", i, 0.0, 0.0) for i in range(n)], NODES), spark.createDataFrame([("g", a, b, None) for a, b in edges], EDGES))


def test_hop_distances_come_in_runs_of_a_node(spark):
    """A writer keeps a run as one value; rows of all nodes a source have no run of more than one."""
    rows = paths.distances(drawn(spark, 200)).select(F.spark_partition_id().alias("at"), "dst").collect()
    runs = len([*itertools.groupby((r.at, r.dst) for r in rows)])
    assert len(rows) > 30_000 and runs * 20 < len(rows)


def test_surroundings_of_a_node_are_held_without_a_value_a_node_of_the_graph():
    r = np.random.default_rng(1)
    g = K.Csr(np.arange(60), *r.integers(0, 60, (2, 70)))
    far = np.minimum(K.hops(g, np.arange(60)), 3.0)
    assert all((K.WithinThree(g, i)[np.arange(60)] == far[i]).all() for i in range(60))
    ring = np.arange(100_000)
    tracemalloc.start()
    g = K.Csr(ring, ring, np.roll(ring, 1))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    held = [K.WithinThree(g, i) for i in range(64)]
    grown = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert len(held) == 64 and grown < 1 << 20


def test_sketches_do_not_pass_through_the_driver(spark, monkeypatch):
    plans, cut = [], large.cut
    monkeypatch.setattr(large, "cut", lambda df, name="step": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(df, name))
    assert large.ball_estimates(drawn(spark, 20)).count() > 40
    steps = [p for name, p in plans if name == "sketches"][1:]
    assert steps and all("SortMergeJoin" in p and "Broadcast" not in p for p in steps)
