"""Samples of a large network: every value once with its count, the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.frame import NetworkFrame
from filigree.operators import components as C
from filigree.operators import topology as T
from filigree.operators.growth import Counted, Params, Sample, network

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, u long, v long, weight double"


def grid(spark, rows):
    nodes = spark.range(40 * rows).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), (F.col("id") % 40).cast("double").alias("x"), F.floor(F.col("id") / 40).cast("double").alias("y"))
    right = nodes.where("x < 39").select("graph_id", F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"))
    down = nodes.where(F.col("y") < rows - 1).select("graph_id", F.col("node_id").alias("u"), (F.col("node_id") + 40).alias("v"))
    return NetworkFrame(nodes, right.unionByName(down).withColumn("weight", F.lit(None).cast("double")))


def test_a_counted_list_is_its_list():
    every = sorted(np.random.default_rng(1).integers(0, 5, 50).astype(float).tolist())
    values, n = np.unique(every, return_counts=True)
    short = Counted(values, n.cumsum())
    assert len(short) == 50 and [short[i] for i in range(50)] == every
    assert not Counted(np.zeros(0), np.zeros(0, int))


def test_growth_draws_alike_from_few_values(spark):
    net = grid(spark, 50)
    whole, short = (Sample.of_row(T.attributes(net, counts_of_values=c).first()) for c in (False, True))
    assert {k: [v[i] for i in range(len(v))] for k, v in short.lengths.items()} == whole.lengths
    assert {k: [v[i] for i in range(len(v))] for k, v in short.angles.items()} == whole.angles
    assert sum(len(v) for v in whole.lengths.values()) > 7000 and sum(len(v.values) for v in short.lengths.values()) <= 3
    got = [network(s, Params(width=14.0, height=14.0, seed=3))[0] for s in (whole, short)]
    assert all((a == b).all() for a, b in zip(*got)) and len(got[0][0]) > 0


@pytest.mark.parametrize("local", [3, 200])
def test_ranges_of_a_line_leave_few_links(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    rounds, hooked = [], C._hooked
    monkeypatch.setattr(C, "_hooked", lambda links, *a: rounds.append(links.count()) or hooked(links, *a))
    nodes = spark.range(1200).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = spark.range(1199).where("id % 400 <> 399").select(F.lit("g").alias("graph_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(None).cast("double").alias("weight"))
    got = {r.node_id: r.label for r in C.components(NetworkFrame(nodes, edges)).collect()}
    assert got == {i: i - i % 400 for i in range(1200)}
    assert sum(rounds) < (500 if local == 3 else 1)
