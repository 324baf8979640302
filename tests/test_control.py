"""Runs that are cancelled, names in SQL text, and degrees as state."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from filigree.frame import NetworkFrame
from filigree.functions import geometry as G
from filigree.functions import sql
from filigree.operators import paths
from filigree.plans import runs
from filigree.sources import sinks, spec
from filigree.streaming import degrees


def small(spark):
    nodes = spark.createDataFrame([("g", k, float(k % 4), float(k // 4)) for k in range(12)], "graph_id string, node_id long, x double, y double")
    edges = spark.createDataFrame([("g", k, k + 1, None) for k in range(11)], "graph_id string, u long, v long, weight double")
    return NetworkFrame(nodes, edges)


def begun(spark, tmp_path, source):
    text = {"contract": 2, "mode": "generate", "run_name": "r", "output_dir": str(tmp_path), "inputs": {"network_graphml": "nowhere"}, "params": {"CLOSED_NODES_FACTOR": 1.0, "CLOSED_EDGES_FACTOR": 1.0}}
    config, inputs = spec.from_spec(json.dumps(text))
    return runs.Background(spark, config, inputs, source)


def only_manifest(spark, tmp_path):
    [root] = tmp_path.iterdir()
    return sinks.read_manifest(spark, str(root))


def test_a_run_stuck_in_a_job_is_cancelled_after_its_grace(spark, tmp_path):
    def stuck(spark, name):
        slow = spark.range(4).mapInPandas(lambda batches: (time.sleep(120) or b for b in batches), "id long")
        slow.count()
        return small(spark)

    run = begun(spark, tmp_path, stuck)
    assert run.wait(4) == "running"
    at = time.time()
    assert run.cancel(grace=1) == "cancelled" and time.time() - at < 30
    assert only_manifest(spark, tmp_path)["status"] == "cancelled"
    assert spark.range(3).count() == 3


def test_a_run_ends_by_itself_within_its_grace(spark, tmp_path):
    def waits(spark, name):
        time.sleep(2)
        return small(spark)

    run = begun(spark, tmp_path, waits)
    assert run.cancel(grace=60) == "cancelled" and only_manifest(spark, tmp_path)["status"] == "cancelled"


def test_a_run_that_ends_or_fails_says_so(spark, tmp_path):
    assert begun(spark, tmp_path / "a", lambda s, n: small(s)).wait() == "ok"

    def broken(spark, name):
        raise OSError("gone")

    run = begun(spark, tmp_path / "b", broken)
    assert run.wait() == "failed" and only_manifest(spark, tmp_path / "b")["error"] == "OSError: gone"


def test_segments_in_sql_text_are_those_of_columns(spark):
    sql.register(spark)
    r = random.Random(4)
    rows = [tuple(float(r.randint(0, 4)) for _ in range(8)) for _ in range(400)]
    names = [f"{p}{c}" for p in "abcd" for c in "xy"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    column = G.segments_intersect(tuple(F.col(n) for n in names[:4]), tuple(F.col(n) for n in names[4:]))
    got = df.select(F.expr(f"segments_intersect({', '.join(names)})").alias("a"), column.alias("b"))
    assert got.where("a <> b or a is null").count() == 0 and got.where("a").count() not in (0, 400)


def test_table_function_equals_balls(spark):
    sql.register(spark)
    net = small(spark)
    two = net.edges.unionByName(net.edges.where("u % 3 > 0").withColumn("graph_id", F.lit("h")))
    two.select("graph_id", "u", "v").createOrReplaceTempView("two_graphs")
    got = spark.sql("SELECT * FROM sp_histogram(TABLE(two_graphs) PARTITION BY graph_id)")
    ends = sorted({(r.graph_id, k) for r in two.collect() for k in (r.u, r.v)})
    want = paths.balls(NetworkFrame(spark.createDataFrame(ends, "graph_id string, node_id long"), two))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def streamed(spark, folder, changes, batches):
    for part in batches(changes):
        spark.createDataFrame(part, degrees.CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(degrees.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = degrees.degree_updates(stream).writeStream.format("memory").queryName(folder.name).outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in degrees.standing(spark.table(folder.name)).where("edges > 0").collect())


def test_two_orders_of_changes_give_the_batch_degrees(spark, tmp_path):
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    degrees.with_state_store(spark)
    try:
        r = random.Random(9)
        edges = [("g", r.randint(0, 9), r.randint(0, 9)) for _ in range(40)]
        gone = edges[::3]
        changes = [(*e, 1) for e in edges] + [(*e, -1) for e in gone]
        left = list(edges)
        for e in gone:
            left.remove(e)
        ends = [(a, b) for _, u, v in left for a, b in ({(u, v), (v, u)})]
        want = sorted(("g", n, len({b for a, b in ends if a == n}), sum(a == n for a, _ in ends)) for n in {a for a, _ in ends})
        forth = streamed(spark, tmp_path / "forth", changes, lambda c: (c[:30], c[30:]))
        back = streamed(spark, tmp_path / "back", changes[::-1], lambda c: (c[:10], c[10:25], c[25:]))
        assert forth == back == want
    finally:
        spark.conf.set(kind, before)


class Calls:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.count, self.value, self.map, self.timers = 0, None, {}, []

    def getMapState(self, *_):  # noqa: N802
        return self

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def get(self):
        self.count += 1
        return self.value

    def update(self, value):
        self.count, self.value = self.count + 1, value

    def containsKey(self, key):  # noqa: N802
        self.count += 1
        return key in self.map

    def getValue(self, key):  # noqa: N802
        self.count += 1
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.count += 1
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        self.count += 1
        del self.map[key]

    def iterator(self):
        return iter(list(self.map.items()))


def changed(state, rows, few=256, keep=None, now=0):
    from types import SimpleNamespace as Of

    p = degrees.Degrees(keep, few)
    p.init(state)
    sent = p.handleInputRows(("g", 0), iter([Of(node_id=a, other=b, change=c) for a, b, c in rows]), Of(getCurrentWatermarkInMs=lambda: now))
    return [(r.node_id, r.version, r.degree, r.edges) for r in sent]


def test_state_of_a_block_is_read_and_written_once_a_batch():
    state = Calls()
    ring = [(a, b % 50, 1) for a in range(50) for b in (a + 1, a + 49)]
    assert changed(state, ring) == [(a, 1, 2, 2) for a in range(50)]
    assert state.count == 2
    assert changed(state, [(3, 4, 1), (3, 4, -1), (7, 8, -1)]) == [(7, 2, 1, 1)]
    assert state.count == 4


def test_neighbours_of_a_hub_move_to_a_map():
    from types import SimpleNamespace as Of

    few, many = Calls(), Calls()
    for rows in ([(1, b, 1) for b in range(9)] + [(2, 1, 1)], [(1, b, -1) for b in range(0, 9, 2)] + [(1, 20, -1)], [(1, 20, 2), (1, 1, 1), (2, 1, -1)]):
        assert changed(few, rows) == changed(many, rows, few=4)
    assert not few.map and sorted(many.map) == [(1, b) for b in (1, 3, 5, 7, 20)]
    for few_ in (256, 2):
        state = Calls()
        changed(state, [(1, b, 1) for b in range(4)], few_, keep=10, now=0)
        changed(state, [(1, 3, 1)], few_, keep=10, now=5000)
        p = degrees.Degrees(10, few_)
        p.init(state)
        told = [(r.node_id, r.version, r.degree, r.edges) for r in p.handleExpiredTimer(("g", 0), None, Of(getExpiryTimeInMs=lambda: 10_000))]
        assert told == [(1, 3, 1, 2)] and state.timers == [10_000, 15_000]


@pytest.mark.parametrize("name", ["stream_degree_changes", "sp_histogram_sql", "format_networks", "log_tail"])
def test_queries_are_registered_with_sql(name):
    from filigree.plans import file_oracles, file_queries, oracles, queries  # noqa: F401

    assert name in queries.QUERIES and name in oracles.ORACLES


@pytest.mark.parametrize(("full", "weights"), [(False, False), (True, True), (False, None)])
def test_compare_passes_on_band_and_weights(spark, tmp_path, monkeypatch, full, weights):
    net = small(spark)
    asked = []

    def reports(original, synthetic, full_band):
        asked.append((original.weighted, synthetic.weighted, full_band))
        return spark.createDataFrame([(k, f"g{i}", [1.0, 2.0], [3.0, 4.0]) for k in ("original", "synthetic") for i in (1, 0)], "label string, graph_id string, al_list array<double>, fal_list array<double>")

    monkeypatch.setattr(runs.P, "compare", reports)
    monkeypatch.setattr(runs.tables, "load", lambda s, path: NetworkFrame(net.nodes, net.edges.withColumn("weight", F.lit(2.0)), True))
    params = {"FULL_Q_BAND": full} | ({} if weights is None else {"MEASURE_WEIGHTED": weights})
    text = {"contract": 2, "mode": "compare", "run_name": "c", "output_dir": f"{tmp_path}/out", "inputs": {"original_networks": "a", "synthetic_networks": "b"}, "params": params}
    root = runs.run_spec(spark, json.dumps(text))
    want = weights is not False
    assert asked == [(want, want, full)]
    done = sinks.read_manifest(spark, root)
    assert done["status"] == "ok" and sorted(done["outputs"]["analysis"]) == ["c/analysis_data_original.json", "c/analysis_data_synthetic.json", "c/spectra_analysis.csv"]
    rows = spark.read.json(f"{root}/c/analysis_data_original.json").collect()
    assert [r.graph_id for r in rows] == ["g0", "g1"] and spark.read.csv(f"{root}/c/spectra_analysis.csv", header=True).count() == 8
