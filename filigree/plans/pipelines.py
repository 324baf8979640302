"""Whole runs: analyse, compare, generate, select, sweep, hybrid; candidates are rows, never processes."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..operators import growth as Gr
from ..operators import multifractal as M
from ..operators import ranking as R
from ..operators import topology as T
from ..operators import weights as W
from ..operators.components import largest_component, trim
from ..session import cut

#: ``rng`` is the state of the candidate's random stream behind this attempt.
GROWN = "trial string, candidate_id long, attempt int, node_factor double, edge_factor double, nodes array<struct<node_id:long,x:double,y:double>>, edges array<struct<u:long,v:long,weight:double>>, tries int, merged int, aborted int, rng string, reached boolean"
WANTED = ("trial", "candidate_id", "node_factor", "edge_factor", "rng")


def _row(net: Gr.Network) -> tuple[list[dict], list[dict]]:
    xy, edges = net
    return [{"node_id": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate(xy)], [{"u": int(a), "v": int(b), "weight": None} for a, b in edges]


def stream_of(seed: int | None, worker: int, state: str | None) -> np.random.Generator:
    """Worker i's stream is that of seed + i; a state goes on where an attempt left off."""
    rng = np.random.default_rng(None if seed is None else seed + worker)
    if state:
        rng.bit_generator.state = json.loads(state)
    return rng


def candidates(spark: SparkSession, params: Gr.Params, count: int, trial: str = "run") -> DataFrame:
    """WANTED rows of candidates 0 .. count - 1."""
    return spark.range(count).select(F.lit(trial).alias("trial"), F.col("id").alias("candidate_id"), F.lit(params.node_factor).alias("node_factor"), F.lit(params.edge_factor).alias("edge_factor"), F.lit(None).cast("string").alias("rng"))


def grow(spark: SparkSession, sample: Gr.Sample, params: Gr.Params, count: int, wanted: DataFrame | None = None, attempt: int = 0, until: int = 0, every: int = 1) -> DataFrame:
    """GROWN rows, one a candidate, each in a task of its own.

    WANTED rows name other candidates than 0 .. count - 1. With ``until`` growth stops at the
    first of every ``every`` rounds that has so many nodes, and ``reached`` says whether it did.
    """
    wanted = candidates(spark, params, count) if wanted is None else wanted

    def run(batches):
        for batch in batches:
            rows = []
            for trial, c, nf, ef, state in batch[list(WANTED)].itertuples(index=False):
                p = replace(params, node_factor=float(nf), edge_factor=float(ef))
                rng = stream_of(p.seed, int(c), state)
                # An attempt that fails has grown nothing, which no gate passes; the next one goes on in the same stream.
                try:
                    net, stats = Gr.early_network(sample, p, rng, until, every) if until else Gr.network(sample, p, int(c), rng=rng)
                except (ArithmeticError, LookupError, ValueError, RuntimeError):
                    net, stats = (np.zeros((0, 2)), np.zeros((0, 2), int)), {"tries": 0, "merged": 0, "aborted": 0}
                rows.append((trial, c, attempt, nf, ef, *_row(net), stats["tries"], stats["merged"], stats["aborted"], json.dumps(rng.bit_generator.state), bool(stats.get("reached", False))))
            yield pd.DataFrame(rows, columns=["trial", "candidate_id", "attempt", "node_factor", "edge_factor", "nodes", "edges", "tries", "merged", "aborted", "rng", "reached"])

    n = wanted.count()
    numbered = wanted.select(*WANTED, (F.row_number().over(Window.orderBy("trial", "candidate_id")) - 1).alias("task"))  # one row a candidate
    dealt = numbered.repartitionById(max(1, n), F.col("task").cast("int"))
    return cut(dealt.mapInPandas(run, GROWN), "grown")


def graph_id() -> Column:
    return F.concat_ws("/", "trial", "candidate_id").alias("graph_id")


def grown_frame(grown: DataFrame, weighted: bool = False) -> NetworkFrame:
    """Candidates as networks; graph_id is trial/candidate."""
    nodes = grown.select(graph_id(), F.explode("nodes").alias("n")).select("graph_id", "n.*")
    edges = grown.select(graph_id(), F.explode("edges").alias("e")).select("graph_id", "e.*")
    return NetworkFrame(nodes, edges, weighted)


def finished(grown: DataFrame, sample: Gr.Sample, weigh: DataFrame | None, seed: int | None) -> NetworkFrame:
    """Grown networks trimmed to the measured average degree, and weighted where there is a model."""
    net = grown_frame(grown)
    net = trim(net, net.nodes.select("graph_id").distinct().withColumn("target_degree", F.lit(float(sample.average_degree))))
    if weigh is not None:
        net = W.assign(net, weigh, seed or 0)
    return kept(net)


def with_networks(rows: DataFrame, net: NetworkFrame) -> DataFrame:
    """GROWN-like rows (graph_id, ...) with the nodes and edges of net."""
    nodes = net.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "x", "y"))).alias("nodes"))
    edges = net.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "weight"))).alias("edges"))
    none = F.array().cast("array<struct<u:bigint,v:bigint,weight:double>>")
    out = rows.drop("nodes", "edges").join(nodes, "graph_id").join(edges, "graph_id", "left")
    return out.withColumn("edges", F.coalesce("edges", none))


def accepted(spark: SparkSession, original: NetworkFrame, sample: Gr.Sample, params: Gr.Params, wanted: DataFrame, gate: str, tolerance: float, attempts: int = 10, early: int = 0, every: int = 1, full_band: bool = False) -> DataFrame:
    """GROWN rows with ``error`` whose networks, trimmed and weighted, pass the gate: waves of attempts over
    the candidates still failing, each going on in its own random stream.

    With ``early`` a candidate is judged once when it has that many nodes (looked at every ``every``
    rounds) and given up for this attempt if it fails then.  A candidate whose attempts all fail is left out.
    """
    weigh = cut(W.fit(original), "mapper") if original.weighted else None
    out, left = None, wanted if "rng" in wanted.columns else wanted.withColumn("rng", F.lit(None).cast("string"))
    key = ["trial", "candidate_id"]
    for attempt in range(attempts):
        pool, given_up = left, None
        if early:
            begun = grow(spark, sample, params, 0, left, attempt, early, every)
            judged = R.checked(finished(begun.where("reached"), sample, weigh, params.seed), original, gate, tolerance, full_band)
            bad = cut(begun.select(*key, "rng", graph_id()).join(judged.where("not passed"), "graph_id").select(*key, "rng"), "given-up")
            pool = left.join(bad, key, "left_anti")
            given_up = left.drop("rng").join(bad, key)
        grown = grow(spark, sample, params, 0, pool, attempt)
        net = finished(grown, sample, weigh, params.seed)
        judged = R.checked(net, original, gate, tolerance, full_band).where("passed").select("graph_id", "error")
        got = cut(with_networks(grown.withColumn("graph_id", graph_id()).join(judged, "graph_id"), net).drop("graph_id"), "passed")
        out = got if out is None else out.unionByName(got)
        failed = grown.join(got.select(*key), key, "left_anti").select(*WANTED)
        left = cut(failed if given_up is None else failed.unionByName(given_up.select(*WANTED)), "failing")
        if left.isEmpty():
            break
    return out


def kept(net: NetworkFrame) -> NetworkFrame:
    """net written once, so that what is measured on it many times is derived once."""
    return NetworkFrame(cut(net.nodes, "nodes"), cut(net.edges, "edges"), net.weighted)


def sample_of(net: NetworkFrame) -> Gr.Sample:
    return Gr.Sample.of_row(T.attributes(net, Gr.MOST_VALUES).first())


def generate(spark: SparkSession, original: NetworkFrame, params: Gr.Params, count: int, gate: str = "multifractal", tolerance: float = 0.15, attempts: int = 10, full_band: bool = False, early: int = 0, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """(accepted candidates, one row with the robust mean error)."""
    got = accepted(spark, original, sample_of(original), params, candidates(spark, params, count), gate, tolerance, attempts, early, every, full_band)
    return got, R.robust_mean(got, "trial")


def generate_select(spark: SparkSession, original: NetworkFrame, params: Gr.Params, count: int, best: int, gate: str = "multifractal", tolerance: float = 0.15) -> DataFrame:
    """The ranking report of the best candidates, the original first."""
    got, _ = generate(spark, original, params, count, gate, tolerance)
    errors = got.select(F.concat_ws("/", "trial", "candidate_id").alias("graph_id"), "error")
    return R.ranking_report(T.metrics(grown_frame(got)), T.metrics(original), errors, best)


def sweep(spark: SparkSession, original: NetworkFrame, params: Gr.Params, low: float, high: float, step: float, count: int, gate: str = "multifractal", tolerance: float = 0.15, attempts: int = 1) -> DataFrame:
    """As ``sweep_grid`` with one range for both factors."""
    return sweep_grid(spark, original, params, (low, high), (low, high), step, count, gate, tolerance, attempts)


def sweep_grid(spark: SparkSession, original: NetworkFrame, params: Gr.Params, node_range: tuple[float, float], edge_range: tuple[float, float], step: float, count: int, gate: str = "multifractal", tolerance: float = 0.15, attempts: int = 1, full_band: bool = False) -> DataFrame:
    """(node_factor, edge_factor, error, success_rate) of every factor pair, all trials in one job."""
    grid = R.factor_grid(spark.range(1), *node_range, step, edge_range).withColumn("trial", F.concat_ws("_", "node_factor", "edge_factor"))
    wanted = grid.withColumn("candidate_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).withColumn("rng", F.lit(None).cast("string"))
    got = accepted(spark, original, sample_of(original), params, wanted, gate, tolerance, attempts, full_band=full_band)
    rate = got.groupBy("trial").agg((F.count("*") / count).alias("success_rate"))
    out = grid.join(R.robust_mean(got, "trial"), "trial", "left").join(rate, "trial", "left")
    return out.select("node_factor", "edge_factor", F.coalesce("error", F.lit(float("inf"))).alias("error"), F.coalesce("success_rate", F.lit(0.0)).alias("success_rate")).orderBy("node_factor", "edge_factor")


def grow_snapshots(spark: SparkSession, sample: Gr.Sample, params: Gr.Params, every: int, most_rounds: int = 100_000) -> DataFrame:
    """(snapshot_ix, round, nodes, edges) of one network while it grows, in one task; the last row is the grown network."""

    def run(batches):
        for _ in batches:
            want, rows = set(Gr.snapshot_rounds(every, most_rounds)), []
            look = lambda k, plane: rows.append((k, *_row(Gr.largest(*Gr.arrays(plane))))) if k in want else None
            net, _ = Gr.network(sample, params, on_round=look)
            rows.append((rows[-1][0] + 1 if rows else 1, *_row(net)))
            yield pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["snapshot_ix", "round", "nodes", "edges"])

    schema = "snapshot_ix int, round int, nodes array<struct<node_id:long,x:double,y:double>>, edges array<struct<u:long,v:long,weight:double>>"
    return cut(spark.range(1).coalesce(1).mapInPandas(run, schema), "snapshots")


def snapshots(sample: Gr.Sample, params: Gr.Params, rounds: list[int]) -> list[tuple[int, Gr.Network]]:
    """The network after each of the rounds while it grows."""
    out: list[tuple[int, Gr.Network]] = []
    want = set(rounds)
    Gr.network(sample, params, on_round=lambda k, plane: out.append((k, Gr.largest(*Gr.arrays(plane)))) if k in want else None)
    return out


def tile_frames(spark: SparkSession, centres: np.ndarray, how: str, params: Gr.Params, factor: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(tile_ix, cx, cy, width, height): fixed frames, or by the distance to the nearest other centre."""
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], "tile_ix long, cx double, cy double")
    if how == "fixed" or len(centres) < 2:
        return c.withColumns({"width": F.lit(params.width), "height": F.lit(params.height)})
    near = T.nearest_other(c.select(F.lit("c").alias("graph_id"), F.col("tile_ix").alias("node_id"), F.col("cx").alias("x"), F.col("cy").alias("y")), max(params.width, params.height))
    side = F.greatest(F.col("distance") * factor, F.lit(floor))
    return c.join(near.select(F.col("node_id").alias("tile_ix"), side.alias("width"), side.alias("height")), "tile_ix")


TILES = "tile_ix long, cx double, cy double, attempt int, rng string, xy array<array<double>>, edges array<array<long>>, frontier array<struct<x:double,y:double,degree:int,base:double,clockwise:boolean,parent:int>>"


def grow_tiles(frames: DataFrame, sample: Gr.Sample, params: Gr.Params, least_nodes: int, attempts: int, original: NetworkFrame | None = None, gate: str = "none", tolerance: float = float("inf"), full_band: bool = False) -> DataFrame:
    """TILES rows with ``error``, one a tile: the first attempt that passes the gate, else the one of least error;
    attempts under ``least_nodes`` don't count, and a tile without any is left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                rng = stream_of(params.seed, int(r.tile_ix), r.rng)
                t = Gr.tile(sample, replace(params, width=r.width, height=r.height), int(r.tile_ix), rng)
                front = [dict(zip(("x", "y", "degree", "base", "clockwise", "parent"), f)) for f in t.frontier]
                rows.append((r.tile_ix, r.cx, r.cy, int(r.attempt), json.dumps(rng.bit_generator.state), t.xy.tolist(), t.edges.tolist(), front))
            yield pd.DataFrame(rows, columns=["tile_ix", "cx", "cy", "attempt", "rng", "xy", "edges", "frontier"])

    left, out = frames.withColumn("rng", F.lit(None).cast("string")), None
    weigh = cut(W.fit(original), "mapper") if original is not None and original.weighted else None
    for attempt in range(max(1, attempts)):
        todo = left.withColumn("attempt", F.lit(attempt))
        tiles = cut(todo.repartition(max(1, todo.count()), "tile_ix").mapInPandas(run, TILES), "tiles")
        fit = tiles.where(F.size("xy") >= least_nodes)
        if gate == "none" or original is None:
            judged = fit.select("tile_ix", F.lit(0.0).alias("error"), F.lit(True).alias("passed"))
        else:
            point = lambda n: F.struct(n[0].alias("x"), n[1].alias("y"))
            nodes = F.transform("xy", lambda n, i: F.struct(i.cast("long").alias("node_id"), point(n).x.alias("x"), point(n).y.alias("y")))
            edges = F.transform("edges", lambda e: F.struct(e[0].alias("u"), e[1].alias("v"), F.lit(None).cast("double").alias("weight")))
            rows = fit.select(F.lit("tile").alias("trial"), F.col("tile_ix").alias("candidate_id"), nodes.alias("nodes"), edges.alias("edges"))
            judged = R.checked(finished(rows, sample, weigh, params.seed), original, gate, tolerance, full_band)
            judged = judged.select(F.substring_index("graph_id", "/", -1).cast("long").alias("tile_ix"), "error", "passed")
        kept = cut(fit.join(judged, "tile_ix"), "judged")
        out = kept if out is None else out.unionByName(kept)
        left = cut(todo.drop("rng", "attempt").join(kept.where("passed"), "tile_ix", "left_anti").join(tiles.select("tile_ix", "rng"), "tile_ix"), "left")
        if left.isEmpty():
            break
    best = out.groupBy("tile_ix").agg(F.min(F.struct(~F.col("passed"), "error", "attempt")).alias("b")).select("tile_ix", F.col("b.attempt").alias("attempt"))
    return out.join(best, ["tile_ix", "attempt"])


def hybrid(
    spark: SparkSession, sample: Gr.Sample, params: Gr.Params, scale: tuple[float, float], most_centres: int, spacing: float, most_rounds: int, least_nodes: int = 30, attempts: int = 3,
    tile: str = "fixed", factor: float = 1.0, floor: float = 0.0, original: NetworkFrame | None = None, gate: str = "none", tolerance: float = 0.15,
    frame: tuple[float, float] | None = None, full_band: bool = False,
) -> tuple[NetworkFrame, int]:
    """Tiles grown apart on all executors, then stitched in order of tile on one plane, trimmed and weighted.

    The board is ``scale`` frames wide and high (``frame``, else the tiles' own size).
    Stitching is sequential by nature and is one task's work; its size is the
    board's, which the caller sets.
    """
    wide, high = frame or (params.width, params.height)
    board = replace(params, width=wide * scale[0], height=high * scale[1])
    rng = params.rng()
    c = Gr.centres(board.width, board.height, spacing * max(wide, high), most_centres, rng) - np.array([board.width / 2, board.height / 2])
    tiles = grow_tiles(tile_frames(spark, c, tile, params, factor, floor), sample, params, least_nodes, attempts, original, gate, tolerance, full_band)
    # The board is padded by one frame on each side.
    padded = replace(board, width=board.width + 2 * wide, height=board.height + 2 * high)

    def stitched(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        placed = [
            (r.cx, r.cy, Gr.Tile(np.array([list(p) for p in r.xy], float).reshape(-1, 2), np.array([list(e) for e in r.edges], int).reshape(-1, 2), [(f["x"], f["y"], f["degree"], f["base"], f["clockwise"], f["parent"]) for f in r.frontier]))
            for r in rows.sort_values("tile_ix").itertuples(index=False)
        ]
        net, rounds = Gr.stitch(sample, padded, placed, most_rounds)
        xy, edges = Gr.cropped(*net, board.width, board.height) if len(net[0]) else net
        nodes = pd.DataFrame({"kind": 0, "a": np.arange(len(xy)), "b": 0, "x": xy[:, 0], "y": xy[:, 1]})
        links = pd.DataFrame({"kind": 1, "a": edges[:, 0].astype(np.int64), "b": edges[:, 1].astype(np.int64), "x": 0.0, "y": 0.0})
        return pd.concat([nodes, links, pd.DataFrame({"kind": [2], "a": [rounds], "b": [0], "x": [0.0], "y": [0.0]})])

    made = cut(tiles.groupBy(F.lit(0).alias("board")).applyInPandas(stitched, "kind int, a long, b long, x double, y double"), "stitched")
    if made.isEmpty():
        raise ValueError("every seed tile failed")
    gid = F.lit("hybrid").alias("graph_id")
    nodes = made.where("kind = 0").select(gid, F.col("a").alias("node_id"), "x", "y")
    net = NetworkFrame(nodes, made.where("kind = 1").select(gid, F.col("a").alias("u"), F.col("b").alias("v"), F.lit(None).cast("double").alias("weight")))
    net = largest_component(trim(net, spark.createDataFrame([("hybrid", float(sample.average_degree))], "graph_id string, target_degree double")), renumber=True)
    if original is not None and original.weighted:
        net = W.assign(net, cut(W.fit(original), "mapper"), params.seed or 0)
    return net, int(made.where("kind = 2").first()["a"])


def expected_nodes(count: int, frame: tuple[float, float], board: tuple[float, float], pad: tuple[float, float]) -> int:
    """Density of the measured network over the padded board."""
    return round(count / (frame[0] * frame[1]) * (board[0] + pad[0]) * (board[1] + pad[1])) if frame[0] * frame[1] else 0


def analyse(sets: dict[str, NetworkFrame], full_band: bool = True, only: set[str] | None = None) -> DataFrame:
    """(label, graph_id, ...): reports of labelled sets of networks, or ``only`` some columns of them."""
    out = None
    for label, net in sets.items():
        r = M.analyse(net, full_band, only).withColumn("label", F.lit(label))
        out = r if out is None else out.unionByName(r)
    return out


def compare(original: NetworkFrame, synthetic: NetworkFrame, full_band: bool = False) -> DataFrame:
    return analyse({"synthetic": synthetic, "original": original}, full_band)


def spectra_table(reports: DataFrame) -> DataFrame:
    """(label, graph_id, ix, alpha, f): what a spectrum figure draws."""
    z = F.arrays_zip(F.col("al_list").alias("alpha"), F.col("fal_list").alias("f"))
    return reports.select("label", "graph_id", F.posexplode(z).alias("ix", "p")).select("label", "graph_id", "ix", "p.*")


#: Resolution of a figure up to so many nodes, beyond them, and what a raster picture adds (fixed values).
DPI_TIERS, MOST_DPI, RASTER_DPI = ((10_000, 150), (100_000, 300), (1_000_000, 600), (10_000_000, 900), (20_000_000, 1200)), 1800, 300


def resolution(nodes: Column, raster: bool = False) -> Column:
    """Resolution tier of figures by their node counts."""
    out = F.lit(MOST_DPI)
    for most, d in reversed(DPI_TIERS):
        out = F.when(nodes < most, d).otherwise(out)
    return out + F.lit(RASTER_DPI if raster else 0)


def dpi(nodes: int, raster: bool = False) -> int:
    """Resolution tier of a figure by its node count."""
    return next((d for most, d in DPI_TIERS if nodes < most), MOST_DPI) + (RASTER_DPI if raster else 0)

