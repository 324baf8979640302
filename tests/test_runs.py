"""Files, specifications, growth, pipelines, streams, and every query against its SQL."""

import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.frame import NetworkFrame
from filigree.operators import components as C
from filigree.operators import growth as Gr
from filigree.operators import topology as T
from filigree.plans import networks, oracles, pipelines, queries, runs
from filigree.sources import sinks, spec, tables
from filigree.streaming import progress

from .test_networks import net, values


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write(text)
    return path


def test_csv_aliases_order_and_last_weight(spark, tmp_path):
    e = put(tmp_path, "a_edgelist.csv", " TO ,From,edge_weight,Width\n1.0,0,2.5,9\n , , , \n0,1,3.5,9\n2,2,1,9\n")
    p = put(tmp_path, "a_positions.csv", "pos_x,POS_Y,note\n1,2,a\n3,4,b\n5,6,c")
    n = tables.read_pair(spark, e, p)
    assert n.weighted and values(n.edges, "u", "v", "weight") == [(0, 1, 3.5), (2, 2, 1.0)]
    assert values(n.nodes, "node_id", "x", "y") == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]
    bare = tables.read_pair(spark, put(tmp_path, "b_EdgeList.csv", "Source,Target\n"), put(tmp_path, "b_NodePositions.csv", "x,y\n1,2\n"))
    assert not bare.weighted and bare.edges.isEmpty() and values(bare.nodes, "x", "y") == [(2.0, 1.0)]


@pytest.mark.parametrize("edges,positions,said", [
    ("source,target\n0,9\n", "x,y\n1,2\n", "node 9"), ("source,target\n-1,0\n", "x,y\n1,2\n", "node -1"), ("a,b\n0,0\n", "x,y\n1,2\n", "no column source"),
    ("source,target\n0,0\n", "x,z\n1,2\n", "no column y"), ("source,target\n0,0\n", "x,y\n", "no positions"), ("source,target\n0,0\n0,q\n", "x,y\n1,2\n", "line 3"), ("source,target,weight\n0,0,0\n", "x,y\n1,2\n", "non-positive"),
])
def test_csv_errors(spark, tmp_path, edges, positions, said):
    with pytest.raises(Exception, match=said):
        tables.read_pair(spark, put(tmp_path, "e.csv", edges), put(tmp_path, "p.csv", positions)).edges.collect()


@pytest.mark.parametrize("weighted", [False, True])
def test_round_trips(spark, tmp_path, weighted):
    n = net(spark, 4, [(0, 1), (1, 2), (1, 3)], weights=[0.5, 1.25, 3] if weighted else None)
    sinks.write_pair(n, f"{tmp_path}/x")
    back = tables.read_pair(spark, f"{tmp_path}/x_edgelist.csv", f"{tmp_path}/x_positions.csv")
    for gz in (False, True):
        sinks.write_graphml(n, f"{tmp_path}/x{gz}.graphml", gz)
        xml = tables.read_graphml(spark, f"{tmp_path}/x{gz}.graphml")
        for got in (back, xml):
            assert got.weighted == weighted
            assert values(got.edges, "u", "v", "weight") == values(n.edges, "u", "v", "weight") if weighted else values(got.edges, "u", "v") == values(n.edges, "u", "v")
            assert values(got.nodes, "node_id", "x", "y") == values(n.nodes, "node_id", "x", "y")


def test_known_values(spark, sf):
    """The nearest-neighbour network against values computed independently from the definitions."""
    from filigree.operators import multifractal as M
    from filigree.operators import paths as P

    n = networks.knn(spark, sf)
    c, m = T.counts(n).first(), T.metrics(n).first()
    assert (c.node_count, c.edge_count) == (500, 1260)
    near = lambda *x: tuple(pytest.approx(v, rel=1e-7) for v in x)
    assert (m.avg_degree, m.avg_clustering, m.avg_length, m.avg_angle) == near(5.04, 0.037995238095, 0.186014396, 71.428571429)
    r = M.analyse(n).first()
    assert (r.holder_exp, r.other_branch, r.width) == near(2.502894309, 2.500289757, 0.518136849)
    assert (r.tau_list[0], r.tau_list[220], r.tau_list[-1]) == near(-52.076948174, 4.944787939, 44.741369440)
    assert (r.diameter, r.assortativity, r.avg_nfd) == near(7, -0.079159903, 2.676396449)
    assert (r.avg_closeness, r.avg_betweenness, r.avg_ricci, r.avg_eigen) == (*near(0.239594303), *(pytest.approx(v, rel=1e-6) for v in (0.006388102, -0.482594640, 0.041622564)))
    assert P.distances(n).agg(F.sum("d")).first()[0] == 1043228
    assert M.error_features(n).first().spectrum_width == pytest.approx(0.155577292, rel=1e-7)


def test_triples_take_the_component_and_exchange_axes(spark):
    nodes = spark.createDataFrame([("g", 0, 1.0, 2.0), ("g", 1, 3.0, 4.0), ("g", 2, 5.0, 6.0)], "graph_id string, node_id long, x double, y double")
    cells = spark.createDataFrame([("g", 0, 1, 2.0), ("g", 1, 0, 2.0)], "graph_id string, row int, col int, value double")
    n = tables.from_triples(nodes, cells)
    assert values(n.nodes, "node_id", "x", "y") == [(0, 2.0, 1.0), (1, 4.0, 3.0)] and values(n.edges, "weight") == [(2.0,)]


def test_folders(spark, tmp_path):
    n = net(spark, 3, [(0, 1), (1, 2)])
    names = ["d/a_edgelist.csv", "d/a_positions.csv", "d/b.graphml"]
    assert tables.datasets(names) == {"d/a": ("d/a_edgelist.csv", "d/a_positions.csv"), "d/b": ("d/b.graphml",)}
    with pytest.raises(ValueError, match="has no"):
        tables.datasets(["a_edgelist.csv"])
    with pytest.raises(ValueError, match="more than one form"):
        tables.datasets(["a_edgelist.csv", "a_positions.csv", "a.graphml"])
    with pytest.raises(ValueError, match="not a network"):
        tables.load(spark, "x.pkl")
    for name in ("one", "two"):
        lines = "\n".join(r.line for r in sinks.graphml_lines(n).collect())
        put(tmp_path, f"{name}.graphml", lines)
    many = tables.load(spark, str(tmp_path))
    assert T.counts(many).count() == 2 and {r.node_count for r in T.counts(many).collect()} == {3}


def test_many_pairs_in_one_scan(spark, tmp_path):
    put(tmp_path, "a_edgelist.csv", " TO ,From,edge_weight\n1.0,0,2.5\n , , \n0,1,3.5\n2,2,1\n")
    put(tmp_path, "a_positions.csv", "pos_x,POS_Y,note\n1,2,a\n3,4,b\n5,6,c")
    put(tmp_path, "b_EdgeList.csv", "Weight,Source,Target\n4,0,1\n")
    put(tmp_path, "b_NodePositions.csv", "x,y\n1,2\n3,4\n")
    files = tables.datasets([str(tmp_path / f) for f in os.listdir(tmp_path)])
    many = tables.load_set(spark, files, largest=False)
    assert many.weighted
    for g, pair in files.items():
        one = tables.read_pair(spark, *pair)
        mine = lambda df: df.where(F.col("graph_id") == g)  # noqa: E731, B023
        assert values(mine(many.nodes), "node_id", "x", "y") == values(one.nodes, "node_id", "x", "y")
        assert values(mine(many.edges), "u", "v", "weight") == values(one.edges, "u", "v", "weight")
    for name, text, said in (("c_edgelist.csv", "source,target\n0,9\n", "not among"), ("c_edgelist.csv", "source,target\n0,q\n", "line 2"), ("c_edgelist.csv", "a,b\n0,0\n", "no column")):
        put(tmp_path, name, text)
        put(tmp_path, "c_positions.csv", "x,y\n1,2\n")
        with pytest.raises(Exception, match=said):
            tables.load_set(spark, tables.datasets([str(tmp_path / f) for f in os.listdir(tmp_path)]), largest=False).edges.collect()


def test_manifest_and_log(spark, tmp_path):
    for name in ("a_edgelist.csv", "a_positions.csv", "report.csv", "notes.txt"):
        put(tmp_path, name, "x")
    row = sinks.write_manifest(spark, str(tmp_path), "failed", "why")
    assert row["file_count"] == 4 and row["outputs"]["edge_lists"] == ["a_edgelist.csv"] and row["error"] == "why"
    assert json.load(open(tmp_path / "manifest.json")) == row and row["status"] == "failed"
    fine = sinks.write_manifest(spark, str(tmp_path), metrics={"n": 1})
    assert "error" not in fine and fine["metrics"] == {"n": 1} and fine["file_count"] == 4 and sinks.read_manifest(spark, str(tmp_path)) == fine
    os.makedirs(tmp_path / "log")
    log = sinks.RunLog(str(tmp_path / "log" / "run.jsonl"), "r1")
    log.write("begun", dataset="d", percent=5.0)
    log.write("half", dataset="d", percent=50.0)
    put(tmp_path / "log", "more.jsonl", "not json\n")
    stream = progress.log_stream(spark, str(tmp_path / "log"))
    q = progress.latest(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("latest").collect()] == [("r1", "d", 50.0)]
    assert sinks.named("a_", "b", "csv", sinks.stamp(0)) == "a_b_19700101_000000.csv"


GOOD = {
    "contract": 2, "mode": "generate", "run_name": "r", "output_dir": "o", "inputs": {"network_graphml": "n.graphml"},
    "params": {"MEASURE_WEIGHTED": False, "FRAME_SIZE": [512, 512], "SYNTHETIC_FRAME_SIZE": [256, 256], "CLOSED_NODES_FACTOR": 1.0, "CLOSED_EDGES_FACTOR": 1.0},
}


@pytest.mark.parametrize("change,said", [
    ({"contract": 1}, "contract"), ({"mode": "other"}, "mode"), ({"run_name": " "}, "run_name"), ({"inputs": {}}, "inputs: 0 ways"), ({"inputs": {"network_graphml": "a", "datasets_dir": "b"}}, "inputs: 2 ways"),
    ({"inputs": {"edge_list": "a"}}, "inputs: 0 ways"), ({"params": {}}, "missing"), ({"params": {**GOOD["params"], "ODD": 1}}, "unknown"), ({"params": {**GOOD["params"], "CLOSED_NODES_FACTOR": 0}}, "above 0"),
    ({"params": {**GOOD["params"], "SNAPSHOT_INTERVAL": 5, "DISABLE_SAVING": True}}, "snapshots"), ({"contract": None, "mode": None}, "contract"), ({"params": {**GOOD["params"], "SWEEP_STEP": 1}}, "unknown"),
    ({"params": {**GOOD["params"], "ERROR_CHECKER": "odd"}}, "ERROR_CHECKER: must be one of"), ({"params": {**GOOD["params"], "INPUT_ORIENTATION": 3}}, "INPUT_ORIENTATION"), ({"params": {**GOOD["params"], "FRAME_SIZE": [5]}}, "FRAME_SIZE: must be two"),
    ({"params": {**GOOD["params"], "MAX_ATTEMPTS": 1.5}}, "MAX_ATTEMPTS: must be a whole"), ({"params": {**GOOD["params"], "FULL_Q_BAND": "yes"}}, "FULL_Q_BAND"), ({"inputs": [], "params": None}, "inputs: must be an object; params: must be an object"),
    ({"run_name": "", "params": {**GOOD["params"], "ERROR_TOLERANCE": -1, "ODD": 1}}, "run_name: must not be blank; ODD: unknown parameter of mode generate; ERROR_TOLERANCE: must be above 0"),
    ({"mode": "sweep", "params": {"NF_RANGE": [2, 1]}}, "EF_RANGE: is missing; NF_RANGE: must be two numbers above 0, the lower one first"),
])
def test_bad_specifications(change, said):
    with pytest.raises(spec.SpecError, match=said):
        spec.from_spec(json.dumps(GOOD | change))


def test_good_specifications():
    c, i = spec.from_spec(json.dumps(GOOD))
    assert c.frame == (512, 512) and c.max_attempts == 10 and c.error_tolerance == 0.15 and i == GOOD["inputs"] and c.datasets == ("r",) and len(c.run_id) == 8
    bare = {"CLOSED_NODES_FACTOR": 1, "CLOSED_EDGES_FACTOR": 1, "WRITE_NETWORK_GRAPHML_GZ": True, "WRITE_NETWORK_CSV": False, "WRITE_PLOT_PNG": True, "MAX_WORKERS": 3, "SNAPSHOT_INTERVAL": 4, "WRITE_SNAPSHOTS": False}
    c, _ = spec.from_spec(json.dumps(GOOD | {"params": bare, "inputs": {"edge_list": "a", "positions": "b"}}))
    assert (c.frame, c.synthetic_frame, c.measure_weighted, c.network_formats, c.every) == (None, None, None, ("graphml.gz",), 0)
    hybrid = {**GOOD["params"], "TARGET_SCALE": [2, 3], "NUM_CENTERS": 4, "MIN_CENTER_DISTANCE_FACTOR": 0.5, "TILE_FRAME_FACTOR": 1.2, "DATASET_FACTORS": {"a": [0.5, 0.7]}}
    c, _ = spec.from_spec(json.dumps(GOOD | {"mode": "hybrid", "params": hybrid}))
    assert c.factors_of("a/b") == (0.5, 0.7) and c.factors_of("b") == (1.0, 1.0) and c.scale == (2, 3)
    assert spec.labels(["/a/x/n", "/a/y/n"]) == ["x/n", "y/n"] and spec.dataset_id("a", "b") == "a/b"
    for bad in ("[]", "{", json.dumps({k: v for k, v in GOOD.items() if k != "run_name"})):
        with pytest.raises(spec.SpecError):
            spec.from_spec(bad)
    with pytest.raises(ValueError):
        spec.dataset_id("a", "")


SAMPLE = Gr.Sample({1: 0.1, 2: 0.2, 3: 0.5, 4: 0.2}, {k: {1: 0.1, 2: 0.2, 3: 0.5, 4: 0.2} for k in (1, 2, 3, 4)}, {k: [9.0, 10.0, 11.0] for k in (1, 2, 3, 4)}, {2: [170.0, 190.0], 3: [110.0, 120.0, 130.0], 4: [80.0, 90.0, 100.0]}, 10.0, 2.8)
PARAMS = Gr.Params(width=160.0, height=160.0, seed=11)


def test_growth_is_seeded_planar_and_spaced():
    (xy, edges), stats = Gr.network(SAMPLE, PARAMS, 1)
    again, _ = Gr.network(SAMPLE, PARAMS, 1)
    other, _ = Gr.network(SAMPLE, PARAMS, 2)
    assert (xy == again[0]).all() and (edges == again[1]).all() and (len(xy) != len(other[0]) or (xy != other[0]).any())
    assert len(xy) > 20 and stats["tries"] >= 1
    assert np.abs(xy - xy.mean(0)).max() <= 90
    assert len({tuple(e) for e in edges.tolist()}) == len(edges) and (edges[:, 0] != edges[:, 1]).all()
    crossing = 0
    for i in range(len(edges)):
        for j in range(i):
            if not set(edges[i]) & set(edges[j]):
                crossing += Gr.meets(*xy[edges[i][0]], *xy[edges[i][1]], *xy[edges[j][0]], *xy[edges[j][1]])
    assert crossing == 0
    assert len(Gr.largest(xy, edges)[0]) == len(xy)


def test_small_growth_parts():
    assert Gr.snapshot_rounds(3, 10) == [3, 6, 9] and Gr.snapshot_rounds(-4, 100)[0] == 1 and Gr.snapshot_rounds(0, 9) == []
    c = Gr.centres(100, 100, 20, 30, np.random.default_rng(1))
    assert len(c) > 8 and min(math.dist(a, b) for i, a in enumerate(c) for b in c[:i]) >= 20
    assert (c == Gr.centres(100, 100, 20, 30, np.random.default_rng(1))).all()
    assert pipelines.snapshots(SAMPLE, PARAMS, [1, 2]) and pipelines.expected_nodes(100, (10, 10), (20, 20), (10, 10)) == 900
    stop = []
    Gr.network(SAMPLE, Gr.Params(width=160.0, height=160.0, seed=1), on_round=lambda k, p: stop.append(k) or False)
    assert set(stop) == {1}


def test_snapshot_rounds():
    assert Gr.snapshot_rounds(-1, 20) == [1, 2, 4, 8, 16]
    assert Gr.snapshot_rounds(-4, 100)[:4] == [1, 3, 9, 28] and Gr.snapshot_rounds(-3, 8) == [1, 2, 4, 8]


@pytest.mark.parametrize("nodes,want", [(0, 150), (5_000, 150), (9_999, 150), (10_000, 300), (999_999, 600), (10_000_000, 1200), (20_000_000, 1800)])
def test_dpi(nodes, want):
    assert pipelines.dpi(nodes) == want and pipelines.dpi(nodes, raster=True) == want + 300


def one_network(spark, weighted=False):
    grown = pipelines.grow(spark, SAMPLE, PARAMS, 1)
    n = pipelines.grown_frame(grown)
    if not weighted:
        return n
    return NetworkFrame(n.nodes, T.placed_edges(n).select("graph_id", "u", "v", (F.col("length") / 2).alias("weight")), True)


def test_pipelines(spark):
    grown = pipelines.grow(spark, SAMPLE, PARAMS, 3)
    n = pipelines.grown_frame(grown)
    assert T.counts(n).count() == 3
    assert sorted(map(str, grown.collect())) == sorted(map(str, pipelines.grow(spark, SAMPLE, PARAMS, 3).collect()))
    one = NetworkFrame(n.nodes.where("graph_id = 'run/0'"), n.edges.where("graph_id = 'run/0'"))
    report = pipelines.generate_select(spark, one, PARAMS, 2, 1, "none").collect()
    assert [r["rank"] for r in report] == ["original", "1"]
    got, mean = pipelines.generate(spark, one, PARAMS, 2, "length_angle", 1e-12, attempts=1)
    assert got.isEmpty() and mean.isEmpty()
    frames = pipelines.tile_frames(spark, np.array([[0.0, 0.0], [50.0, 0.0], [200.0, 0.0]]), "factor", PARAMS, 0.5, 30.0)
    assert values(frames, "tile_ix", "width") == [(0, 30.0), (1, 30.0), (2, 75.0)]
    whole, rounds = pipelines.hybrid(spark, SAMPLE, Gr.Params(width=90.0, height=90.0, seed=2), (2.0, 1.0), 2, 1.0, 5, least_nodes=5, original=one, gate="length_angle", tolerance=0.5)
    assert C.connectivity(whole).first().connected and 0 < rounds <= 5


def test_accepted_networks_are_trimmed_and_weighted(spark):
    one = one_network(spark, weighted=True)
    sample = pipelines.sample_of(one)
    thin = Gr.Sample(sample.degrees, sample.transitions, sample.lengths, sample.angles, sample.average_length, sample.average_degree * 0.8)
    got = pipelines.accepted(spark, one, thin, PARAMS, pipelines.candidates(spark, PARAMS, 2), "length_angle", 0.9, attempts=1)
    rows = got.collect()
    assert rows and all(2 * len(r.edges) / len(r.nodes) <= 1.1 * thin.average_degree + 1e-9 for r in rows)
    seen = {round(w, 9) for w, in values(one.edges, "weight")}
    drawn = {round(e.weight, 9) for r in rows for e in r.edges}
    # Only empty bins draw the mean.
    assert len(drawn - seen) <= 1
    net = pipelines.grown_frame(got, weighted=True)
    assert C.connectivity(net).where("not connected").isEmpty()


def test_attempts_go_on_in_one_stream(spark):
    first = pipelines.grow(spark, SAMPLE, PARAMS, 1)
    second = pipelines.grow(spark, SAMPLE, PARAMS, 0, first.select(*pipelines.WANTED), 1).first()
    rng = np.random.default_rng(PARAMS.seed)
    one, _ = Gr.network(SAMPLE, PARAMS, rng=rng)
    two, _ = Gr.network(SAMPLE, PARAMS, rng=rng)
    assert [(n.x, n.y) for n in first.first().nodes] == list(map(tuple, one[0])) and [(n.x, n.y) for n in second.nodes] == list(map(tuple, two[0]))


def test_early_abort_saves_attempts(spark):
    one = one_network(spark)
    sample = pipelines.sample_of(one)
    args = (spark, one, sample, PARAMS, pipelines.candidates(spark, PARAMS, 2), "length_angle")
    assert pipelines.accepted(*args, 1e-12, attempts=2, early=10).isEmpty()
    assert pipelines.accepted(*args, 0.9, attempts=1, early=10, every=2).count() > 0
    (xy, _), stats = Gr.early_network(SAMPLE, PARAMS, np.random.default_rng(3), 12)
    assert stats["reached"] and 12 <= len(xy) < 60


def test_whole_runs(spark, tmp_path):
    one = one_network(spark, weighted=True)
    os.makedirs(tmp_path / "in")
    sinks.write_pair(one, f"{tmp_path}/in/demo")
    base = {"contract": 2, "run_name": "r", "output_dir": f"{tmp_path}/out", "inputs": {"datasets_dir": f"{tmp_path}/in"}}
    shared = {"MEASURE_WEIGHTED": True, "FRAME_SIZE": [160, 160], "SEED": 5, "ERROR_CHECKER": "length_angle", "ERROR_TOLERANCE": 0.9, "MAX_ATTEMPTS": 1}
    grow = {**shared, "CLOSED_NODES_FACTOR": 1.0, "CLOSED_EDGES_FACTOR": 1.0, "SYNTHETIC_NETWORK_NUMBER": 2}
    for mode, params, kinds in (
        ("generate", grow, {"edge_lists", "positions", "other"}),
        ("generate", {**grow, "SELECT_BEST": 1}, {"edge_lists", "positions", "other"}),
        ("generate", {**grow, "SNAPSHOT_INTERVAL": 2}, {"edge_lists", "positions", "other", "snapshots"}),
        ("sweep", {**shared, "SYNTHETIC_NETWORK_NUMBER": 1, "NF_RANGE": [1.0, 1.0], "EF_RANGE": [0.8, 1.0], "SWEEP_STEP": 0.2}, {"other"}),
        ("hybrid", {**grow, "FRAME_SIZE": [90, 90], "TARGET_SCALE": [1, 2], "NUM_CENTERS": 2, "MIN_CENTER_DISTANCE_FACTOR": 0.8, "TILE_FRAME_FACTOR": 1.0, "MIN_TILE_NODES": 5, "PHASE2_MAX_ROUNDS": 4, "DATASET_FACTORS": {"demo": [0.9, 0.9]}, "WRITE_NETWORK_GRAPHML": True}, {"networks", "other"}),
    ):
        root = runs.run_spec(spark, json.dumps(base | {"mode": mode, "params": params}))
        done = sinks.read_manifest(spark, root)
        assert done["status"] == "ok" and "error" not in done and kinds <= set(done["outputs"]), mode
        log = progress.parsed(spark.read.text(f"{root}/run.jsonl"))
        assert {r.dataset for r in log.collect()} == {"demo"} and log.count() >= 2
    with pytest.raises(ValueError, match="synthetic networks"):
        runs.run_spec(spark, json.dumps(base | {"mode": "sweep", "output_dir": f"{tmp_path}/bad", "params": {**shared, "NF_RANGE": [1, 1], "EF_RANGE": [1, 1]}}))
    [bad] = os.listdir(tmp_path / "bad")
    failed = sinks.read_manifest(spark, f"{tmp_path}/bad/{bad}")
    assert failed["status"] == "failed" and failed["error"].startswith("ValueError: a sweep needs")
    own = runs.run_spec(spark, json.dumps(base | {"mode": "generate", "output_dir": f"{tmp_path}/own", "inputs": {"network_graphml": "nowhere"}, "params": {**grow, "SYNTHETIC_NETWORK_NUMBER": 0}}), source=lambda s, name: one)
    assert sinks.read_manifest(spark, own)["file_count"] >= 4


def test_degree_stream(spark, tmp_path):
    spark.createDataFrame([("g", 0, 1), ("g", 1, 2)], "graph_id string, u long, v long").write.parquet(f"{tmp_path}/e")
    s = progress.degree_stream(spark.readStream.schema("graph_id string, u long, v long").parquet(f"{tmp_path}/e"))
    s.writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert values(spark.table("deg"), "node_id", "degree") == [(0, 1), (1, 2), (2, 1)]


FAST = ("degree_transitions", "angle_gaps", "network_metrics", "weighted_degree", "clustering_onnela", "components", "trim_topk_round1", "orient_rot90", "apsp_hops", "apsp_weighted", "tau_q", "feature_pair", "node_dimension", "length_bins", "bin_assignment", "knn_pairs", "segment_intersections", "robust_mean_error", "session_transitions", "manifest_classify", "log_progress")


@pytest.mark.parametrize("name", FAST)
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert networks.knn(spark, "/root/testdata/sf0.001").nodes.count() == 500


def test_trials_snapshots_frames_and_names(spark, tmp_path):
    t = spark.createDataFrame([(0.5, 1.0, 0.1, 0.9), (0.6, 1.0, 0.2, 1.0)], "node_factor double, edge_factor double, error double, success_rate double")
    tables.write_trials(t, f"{tmp_path}/t")
    assert values(tables.read_trials(spark, f"{tmp_path}/t"), *t.columns) == values(t, *t.columns)
    f = spark.createDataFrame([(f"s/snapshot_{i:05d}_{k}.npy",) for i in (7, 3) for k in ("positions", "edges")] + [("s/snapshot_00009_edges.npy",)], "path string")
    assert [r.snapshot_ix for r in tables.snapshot_pairs(f).collect()] == [3, 7]
    n = net(spark, 3, [(0, 1), (1, 2)], xy=[(0, 0), (10.2, 3), (4, 5)])
    assert values(tables.frame_of(n), "width", "height") == [(11.0, 5.0)]
    assert values(tables.frame_of(n, 1100), "width", "height") == [(1100.0, 500.0)]
    assert tables.resized((200, 100), (1024, 512)) == (1024, 512)
    sinks.write_pair(n, f"{tmp_path}/n")
    paths = [f"{tmp_path}/n_edgelist.csv", f"{tmp_path}/n_positions.csv"]
    assert tables.load_named(spark, paths, "n").nodes.count() == 3
    with pytest.raises(ValueError):
        tables.load_named(spark, paths, "m")
