"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..functions.numeric import tidy
from ..operators import components as C
from ..operators import multifractal as M
from ..operators import paths as P
from ..operators import ranking as R
from ..operators import topology as T
from ..operators import weights as W
from ..sources import sinks
from ..streaming import progress
from . import networks as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _out(df: DataFrame, ints: str = "", doubles: str = "", strings: str = "") -> DataFrame:
    """Columns by kind: whole numbers, 6 decimals, text."""
    cols = [F.col(c).cast("long").alias(c) for c in ints.split()] + [tidy(F.col(c)).alias(c) for c in doubles.split()] + [F.col(c) for c in strings.split()]
    return df.select(*cols)


@query
def degree_distribution(spark, d):
    return _out(T.degree_distribution(N.knn(spark, d)), "degree n", "share")


@query
def degree_transitions(spark, d):
    return _out(T.degree_transitions(N.knn(spark, d)), "degree_u degree_v n", "prob")


@query
def supply_transitions(spark, d):
    return _out(T.degree_transitions(N.supply(spark, d)), "degree_u degree_v n", "prob")


@query
def degree_lengths(spark, d):
    s = T.degree_lengths(N.knn(spark, d))
    return _out(s.select("degree", F.size("lengths").alias("n"), (F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / F.size("lengths")).alias("mean")), "degree n", "mean")


@query
def degree_angles(spark, d):
    s = T.degree_angles(N.knn(spark, d))
    return _out(s.select("degree", F.size("angles").alias("n"), F.array_max("angles").alias("widest")), "degree n", "widest")


@query
def edge_lengths(spark, d):
    return _out(T.placed_edges(N.knn(spark, d)), "u v", "length angle")


@query
def angle_gaps(spark, d):
    return _out(T.angle_gaps(N.lattice(spark, d)), "node_id seq", "gap")


@query
def network_metrics(spark, d):
    return _out(T.metrics(N.knn(spark, d)), "node_count", "avg_degree avg_clustering avg_length avg_angle")


@query
def metric_distance(spark, d):
    return _out(R.metric_distance(T.metrics(N.lattice(spark, d)), T.metrics(N.knn(spark, d))), "", "distance")


@query
def network_info(spark, d):
    both = [T.counts(f(spark, d)) for f in (N.knn, N.lattice, N.trade)]
    return _out(both[0].unionByName(both[1]).unionByName(both[2]), "node_count edge_count", "", "graph_id")


@query
def weighted_degree(spark, d):
    return _out(T.degrees(N.trade(spark, d)), "node_id degree", "strength")


@query
def clustering_local(spark, d):
    return _out(T.clustering(N.knn(spark, d)), "node_id", "clustering")


@query
def clustering_onnela(spark, d):
    return _out(T.clustering_onnela(N.trade(spark, d)), "node_id", "clustering")


@query
def triangles(spark, d):
    return _out(T.triangles(N.knn(spark, d)), "a b c")


@query
def assortativity(spark, d):
    return _out(T.assortativity(N.knn(spark, d)), "", "assortativity")


@query
def components(spark, d):
    return _out(C.components(N.lattice(spark, d)), "node_id label")


@query
def connectivity(spark, d):
    return _out(C.connectivity(N.lattice(spark, d)).withColumn("top1", F.get("top_sizes", 0)).withColumn("top2", F.get("top_sizes", 1)), "n_components top1 top2", "lcc_share", "connected")


@query
def lcc_nodes(spark, d):
    return _out(C.largest_component(N.lattice(spark, d)).nodes, "node_id", "x y")


@query
def induced_subgraph(spark, d):
    net = N.lattice(spark, d)
    return _out(T.induced(net, net.nodes.where("node_id % 3 <> 0"), renumber=True).edges, "u v")


@query
def trim_topk_round1(spark, d):
    net = N.lattice(spark, d)
    goal = net.nodes.select("graph_id").distinct().withColumn("target_degree", F.lit(2.0))
    return _out(T.trim_round(net, goal).edges, "u v")


@query
def frame_filter(spark, d):
    net = N.lattice(spark, d)
    return _out(T.crop(net, T.frame(net, 200.0, 150.0)).edges, "u v")


@query
def orient_rot90(spark, d):
    return _out(T.oriented(N.lattice(spark, d), "rot90").nodes, "node_id", "x y")


@query
def apsp_hops(spark, d):
    return _out(P.distances(N.knn(spark, d)), "src dst d")


@query
def apsp_frontier(spark, d):
    return _out(P.hop_frontier(N.trade(spark, d)), "src dst d")


@query
def apsp_weighted(spark, d):
    return _out(P.distances(N.trade(spark, d).inverse_weights(), weighted=True), "src dst", "d")


@query
def ball_histogram(spark, d):
    return _out(P.balls(N.knn(spark, d)), "src r cnt")


@query
def ball_mass(spark, d):
    return _out(M.ball_mass(P.balls(N.knn(spark, d))), "src r mass")


@query
def partition_function(spark, d):
    z = M.partition_function(P.balls(N.knn(spark, d)), M.NARROW)
    return _out(z.withColumn("lnz", F.ln("z")), "r", "q lnz")


@query
def tau_q(spark, d):
    return _out(M.tau(P.balls(N.knn(spark, d)), M.WIDE), "", "q tau")


@query
def spectrum(spark, d):
    return _out(M.spectrum(M.tau(P.balls(N.knn(spark, d)), M.NARROW)), "", "q alpha f")


@query
def feature_pair(spark, d):
    return _out(M.error_features(N.knn(spark, d)), "", "holder_exponent spectrum_width")


@query
def dimension_q(spark, d):
    return _out(M.dimensions(M.tau(P.balls(N.knn(spark, d)), M.NARROW)), "", "q dim")


@query
def node_dimension(spark, d):
    return _out(M.node_dimension(N.knn(spark, d)), "node_id", "dimension")


@query
def closeness(spark, d):
    return _out(P.closeness(N.knn(spark, d)), "node_id", "closeness")


@query
def diameter(spark, d):
    return _out(P.diameter(N.knn(spark, d)), "diameter")


@query
def betweenness(spark, d):
    return _out(P.betweenness(N.knn(spark, d)), "node_id", "betweenness")


@query
def eigenvector(spark, d):
    return _out(P.eigenvector(N.knn(spark, d)), "node_id", "eigenvector")


@query
def ricci(spark, d):
    return _out(P.curvature(N.knn(spark, d)), "u v", "curvature")


@query
def ricci_weighted(spark, d):
    return _out(P.curvature(N.trade(spark, d).inverse_weights()), "u v", "curvature")


@query
def neighbour_masses(spark, d):
    return _out(P.neighbour_masses(N.trade(spark, d).inverse_weights()), "u v", "mass")


@query
def analysis_report(spark, d):
    doubles = "dim_diff holder_exp other_branch width assortativity avg_nfd avg_closeness avg_degree avg_clustering avg_betweenness avg_ricci avg_eigen"
    r = M.analyse(N.knn(spark, d), only={"tau_list", "diameter", *doubles.split()})
    return _out(r.withColumn("n_q", F.size("tau_list")), "n_q diameter", doubles)


@query
def length_bins(spark, d):
    return _out(W.length_bins(T.placed_edges(N.knn(spark, d)).select("graph_id", "length")), "bin", "lo hi")


@query
def bin_assignment(spark, d):
    e = T.placed_edges(N.knn(spark, d)).select("graph_id", "u", "v", "length")
    return _out(W.assign_bins(e, W.length_bins(e)), "u v bin")


@query
def weight_mapper(spark, d):
    return _out(W.fit(N.trade(spark, d)).withColumn("n", F.size("weights")), "bin n", "fallback")


@query
def weight_assignment(spark, d):
    """The trade network's weights drawn again by edge length."""
    net = N.trade(spark, d)
    return _out(W.assign(net.make_unweighted(), W.fit(net), seed=7).edges, "u v", "weight")


@query
def weight_assignment_given(spark, d):
    """As weight_assignment, with draws that follow from an edge's ends."""
    net = N.trade(spark, d)
    draw = (F.pmod(F.col("u") * 7919 + F.col("v") * 104729, F.lit(10007)) + 0.5) / 10007
    return _out(W.assign(net.make_unweighted(), W.fit(net), draw=draw).edges, "u v", "weight")


@query
def knn_pairs(spark, d):
    v = N.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _out(N.nearest_vectors(v, 4), "u v rank", "distance")


@query
def range_pairs_grid(spark, d):
    return _out(T.range_pairs(N.lattice(spark, d).nodes, 15.0), "a b", "distance")


@query
def nearest_other(spark, d):
    return _out(T.nearest_other(N.lattice(spark, d).nodes, 5.0), "node_id", "distance")


@query
def segment_intersections(spark, d):
    return _out(T.crossings(N.knn(spark, d), 0.1), "u1 v1 u2 v2")


def _trials(spark, d):
    """Trials of a sweep read from orders: factors by key, errors and rates by price."""
    o = N.table(spark, d, "orders")
    return o.select(((F.col("o_orderkey") % 18) / 10 + 0.3).alias("node_factor"), ((F.floor(F.col("o_orderkey") / 18) % 18) / 10 + 0.3).alias("edge_factor"), F.round(F.col("o_totalprice") / 1000, 0).alias("error"), F.round(F.pmod(F.col("o_custkey"), F.lit(50)) / 50, 2).alias("success_rate"), "o_orderkey")


@query
def pareto_front(spark, d):
    return _out(R.pareto(R.valid_trials(_trials(spark, d))), "o_orderkey", "error success_rate")


@query
def combined_score(spark, d):
    return _out(R.combined_score(R.valid_trials(_trials(spark, d))), "o_orderkey", "score")


@query
def near_one(spark, d):
    return _out(R.near_one(_trials(spark, d), 0.25), "o_orderkey", "node_factor edge_factor")


@query
def best_trials(spark, d):
    return _out(R.top(R.combined_score(R.valid_trials(_trials(spark, d))).withColumn("node_factor", F.col("o_orderkey")), "score"), "o_orderkey", "score")


@query
def robust_mean_error(spark, d):
    o = N.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("trial"), (F.col("o_totalprice") / 1000).alias("error"))
    return _out(R.robust_mean(o, "trial"), "trial", "error")


@query
def factor_grid(spark, d):
    """The grid over the ranges of factors that the trials have."""
    ends = _trials(spark, d).agg(*(f(c).alias(f"{n}_{c}") for c in ("node_factor", "edge_factor") for n, f in (("low", F.min), ("high", F.max))))
    low, high, edge_low, edge_high = ends.first()
    return _out(R.factor_grid(spark.range(1), low, high, 0.1, (edge_low, edge_high)), "", "node_factor edge_factor")


@query
def rank_candidates(spark, d):
    """Market segments' lattices ranked by their distance to the whole one."""
    net, seg = N.lattice(spark, d), N.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("seg"))
    nodes = net.nodes.join(seg, "node_id").select(F.col("seg").alias("graph_id"), "node_id", "x", "y")
    e = net.edges
    for c in ("u", "v"):
        e = e.join(seg.select(F.col("node_id").alias(c), F.col("seg").alias(f"s{c}")), c)
    parts = NetworkFrame(nodes, e.where("su = sv").select(F.col("su").alias("graph_id"), "u", "v", "weight"))
    return _out(R.ranked(T.metrics(parts), T.metrics(net)), "rank", "distance", "graph_id")


@query
def session_transitions(spark, d):
    e = N.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = e.withColumn("next", F.lead("event_type").over(w)).where("next is not null").groupBy("event_type", "next").agg(F.count("*").alias("n"))
    return _out(t.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("event_type"))), "n", "prob", "event_type next")


_KINDS = ("a_edgelist.csv", "A_Positions.CSV", "snapshots/snapshot_00010_positions.npy", "spectra_analysis_figure.webp", "result.json", "net.graphml.gz", "figure.PNG", "snapshots_of_report.txt")


def _files(spark, d):
    names = F.array(*map(F.lit, _KINDS))
    return N.table(spark, d, "orders").select(F.concat(F.lit("run/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.get(names, (F.col("o_orderkey") % 8).cast("int"))).alias("path"))


@query
def manifest_classify(spark, d):
    return _out(_files(spark, d).groupBy(sinks.classify(F.col("path")).alias("kind")).agg(F.count("*").alias("n")), "n", "", "kind")


@query
def manifest_summary(spark, d):
    m = sinks.manifest(_files(spark, d), "run")
    return m.select("status", "run_root", F.col("file_count").cast("long").alias("file_count"), F.size("outputs").cast("long").alias("kinds"))


@query
def log_progress(spark, d):
    """Events written as log lines (some of them cut) and read back."""
    e = N.table(spark, d, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.col("event_type").alias("dataset"), progress.percent(F.col("event_id") % 131, F.lit(131.0)).alias("percent")))
    cut = F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 20)).otherwise(line)
    return _out(progress.latest(progress.parsed(e.select(cut.alias("value")))), "", "percent", "run_id dataset")


@query
def edge_existence(spark, d):
    net = N.trade(spark, d)
    n = net.nodes.select("graph_id", F.col("node_id").alias("u"))
    pairs = n.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    return _out(net.weight_of(pairs), "u v", "weight")


@query
def transposed_positions(spark, d):
    return _out(T.transposed(N.lattice(spark, d)).nodes, "node_id", "x y")


@query
def plot_segments(spark, d):
    """The segment table a renderer would draw, with the median length for its stroke."""
    e = T.placed_edges(N.lattice(spark, d))
    return _out(e.withColumn("median", F.median("length").over(Window.partitionBy("graph_id"))), "u v", "x1 y1 x2 y2 median")


def _sample(spark, d):
    from .pipelines import kept
    from ..operators.growth import Sample

    # Written once, and every value once with its count: all of them are drawn from, and none is repeated in a worker.
    return Sample.of_row(T.attributes(kept(C.largest_component(N.lattice(spark, d))), counts_of_values=True).first())


@query
def grow_networks(spark, d):
    from .pipelines import grown_frame, grow
    from ..operators.growth import Params

    net = grown_frame(grow(spark, _sample(spark, d), Params(width=160.0, height=160.0, seed=1234), 4))
    return _out(T.metrics(net).join(R.robust_mean(T.metrics(net).select("graph_id", F.col("avg_length").alias("error")), "graph_id"), "graph_id"), "node_count", "avg_degree avg_length", "graph_id")


@query
def generate_and_select(spark, d):
    from .pipelines import generate_select
    from ..operators.growth import Params

    net = C.largest_component(N.lattice(spark, d), renumber=True)
    out = generate_select(spark, net, Params(width=160.0, height=160.0, seed=5), 6, 3, "length_angle", 0.5)
    return _out(out, "", "metric_distance", "rank")


@query
def sweep_trials(spark, d):
    from .pipelines import sweep
    from ..operators.growth import Params

    net = C.largest_component(N.lattice(spark, d), renumber=True)
    return _out(sweep(spark, net, Params(width=130.0, height=130.0, seed=9), 0.6, 1.0, 0.4, 2, "length_angle", 0.6), "", "node_factor edge_factor error success_rate")


@query
def hybrid_stitch(spark, d):
    from .pipelines import hybrid
    from ..operators.growth import Params

    net, done = hybrid(spark, _sample(spark, d), Params(width=130.0, height=130.0, seed=3), (2.0, 2.0), 4, 1.0, 30)
    return _out(T.counts(net).withColumn("rounds", F.lit(done)), "node_count edge_count rounds")
