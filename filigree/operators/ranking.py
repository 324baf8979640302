"""Distances between measured networks, gates, ranking, and what a sweep is judged by."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..functions.numeric import py_round
from . import multifractal as M
from . import topology as T

METRICS = ("node_count", "avg_degree", "avg_clustering", "avg_length", "avg_angle")


def relative_error(value: Column, reference: Column) -> Column:
    return F.when(reference != 0, F.abs(value - reference) / F.abs(reference)).otherwise(F.abs(value))


def metric_distance(measured: DataFrame, reference: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(graph_id, distance): mean relative error to the one reference row."""
    ref = reference.select(*(F.col(c).alias(f"ref_{c}") for c in names))
    each = [relative_error(F.col(c), F.col(f"ref_{c}")) for c in names]
    return measured.join(F.broadcast(ref)).select("graph_id", (sum(each[1:], each[0]) / len(each)).alias("distance"))  # one row


Gate = Callable[[NetworkFrame, DataFrame], DataFrame]


def no_gate(net: NetworkFrame, reference: DataFrame) -> DataFrame:
    return net.nodes.select("graph_id").distinct().select("graph_id", F.lit(0.0).alias("error"))


def multifractal_gate(net: NetworkFrame, reference: DataFrame, full_band: bool = False) -> DataFrame:
    """reference: one row of error_features."""
    ref = reference.select(F.col("holder_exponent").alias("rh"), F.col("spectrum_width").alias("rw"))
    f = M.error_features(net, full_band).join(F.broadcast(ref))
    return f.select("graph_id", M.feature_error((F.col("holder_exponent"), F.col("spectrum_width")), (F.col("rh"), F.col("rw"))).alias("error"))


def length_angle_gate(net: NetworkFrame, reference: DataFrame) -> DataFrame:
    """reference: one row of metrics."""
    return metric_distance(T.metrics(net), reference, ("avg_length", "avg_angle")).withColumnRenamed("distance", "error")


GATES: dict[str, tuple[Gate, Callable[[NetworkFrame], DataFrame | None]]] = {
    "none": (no_gate, lambda net: None),
    "multifractal": (multifractal_gate, M.error_features),
    "length_angle": (length_angle_gate, T.metrics),
}


def gate(name: str, full_band: bool = False) -> tuple[Gate, Callable]:
    """A gate and what it measures of the original; the multifractal one over the narrow or the full band of q."""
    if name not in GATES:
        raise ValueError(f"unknown gate {name!r}; one of {sorted(GATES)}")
    judge, feature = GATES[name]
    return (partial(judge, full_band=full_band), partial(feature, full_band=full_band)) if name == "multifractal" else (judge, feature)


def checked(net: NetworkFrame, original: NetworkFrame, name: str, tolerance: float, full_band: bool = False) -> DataFrame:
    """(graph_id, error, passed): passed under the tolerance, strictly; without a gate always."""
    judge, feature = gate(name, full_band)
    e = judge(net, feature(original))
    return e.withColumn("passed", F.lit(True) if name == "none" else F.col("error") < tolerance)


def robust_mean(errors: DataFrame, *keys: str) -> DataFrame:
    """errors(*keys, error) -> (*keys, error): mean of the finite ones within two population deviations, 3 decimals; inf if none."""
    w = Window.partitionBy(*keys)
    e = errors.withColumn("ok", F.when(F.abs("error") < float("inf"), F.col("error")))
    e = e.withColumns({"mu": F.avg("ok").over(w), "sd": F.stddev_pop("ok").over(w)})
    near = F.when(F.abs(F.col("ok") - F.col("mu")) <= 2 * F.col("sd"), F.col("ok"))
    return e.groupBy(*keys).agg(F.avg(near).alias("mean")).select(*keys, F.coalesce(py_round(F.col("mean"), 3), F.lit(float("inf"))).alias("error"))


def ranked(measured: DataFrame, reference: DataFrame, best: int | None = None) -> DataFrame:
    """Candidates by metric distance, ties by id: (rank, graph_id, distance, metrics...)."""
    d = metric_distance(measured, reference).join(measured, "graph_id")
    # Ranks of one run's candidates.
    out = d.withColumn("rank", F.row_number().over(Window.orderBy("distance", "graph_id")))
    return out if best is None else out.where(F.col("rank") <= best)


def ranking_report(measured: DataFrame, reference: DataFrame, errors: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """Report rows, the original first, then the ranked ones."""
    cols = [F.col(c) for c in METRICS]
    first = reference.select(F.lit(0).alias("place"), F.lit("original").alias("rank"), F.lit(0.0).alias("metric_distance"), F.lit(0.0).alias("multifractal_error"), *cols)
    r = ranked(measured, reference, best)
    r = r.join(errors.select("graph_id", F.col("error").alias("multifractal_error")), "graph_id", "left") if errors is not None else r.withColumn("multifractal_error", F.lit(None).cast("double"))
    rows = r.select(F.col("rank").alias("place"), F.col("rank").cast("string").alias("rank"), F.col("distance").alias("metric_distance"), "multifractal_error", *cols)
    return first.unionByName(rows).orderBy("place").drop("place")


def factors(low: float, high: float, step: float) -> list[float]:
    """round((high - low) / step) + 1 values, 6 decimals."""
    return [round(low + i * step, 6) for i in range(round((high - low) / step) + 1)]


def factor_grid(df_one: DataFrame, low: float, high: float, step: float, edge: tuple[float, float] | None = None) -> DataFrame:
    """(node_factor, edge_factor): every pair of ``factors``; ``edge`` is another range for the edge factor."""
    values = lambda lo, hi: F.explode(F.array(*map(F.lit, factors(lo, hi, step))))
    return df_one.limit(1).select(values(low, high).alias("node_factor")).withColumn("edge_factor", values(*(edge or (low, high))))


def sweep_report(trials: DataFrame) -> DataFrame:
    """Rows of a sweep's report in order of the factors: error with 6 decimals, success rate with 4."""
    error = F.when(F.abs("error") < float("inf"), F.format_string("%.6f", F.col("error"))).otherwise(F.when(F.isnan("error"), "nan").otherwise("inf"))
    return trials.orderBy("node_factor", "edge_factor", "error", "success_rate").select("node_factor", "edge_factor", error.alias("error"), F.format_string("%.4f", F.col("success_rate")).alias("success_rate"))


#: Text of a metric line, and headings, widths and formats of a ranking table (fixed values).
METRIC_LINE = "nodes=%d  avg_deg=%.2f  clust=%.4f  length=%.2f  angle=%.2f"
TABLE = (("Rank", 4, "d"), ("Dist", 8, ".4f"), ("MFErr", 8, ".4f"), ("Nodes", 7, "d"), ("AvgDeg", 7, ".2f"), ("Clust", 8, ".4f"), ("Length", 8, ".2f"), ("Angle", 8, ".2f"))
OWN_ROW = "Orig"


def metric_line() -> Column:
    """A network's metrics in one line of text."""
    return F.format_string(METRIC_LINE, *(F.col(c) for c in METRICS))


def table_text(ranked_rows: DataFrame, reference: DataFrame) -> list[str]:
    """Lines of a ranking table: ranked rows (rank, distance, error, metrics), then the original's."""
    head = " ".join(f"{name:>{width}}" for name, width, _ in TABLE)
    cells = [f"%{width}{kind}" for _, width, kind in TABLE]
    rows = ranked_rows.orderBy("rank").select(F.format_string(" ".join(cells), "rank", "distance", "error", *METRICS).alias("line"))
    blank = [f"%{width}s" for _, width, _ in TABLE[:3]]
    own = reference.select(F.format_string(" ".join([*blank, *cells[3:]]), F.lit(OWN_ROW), F.lit(""), F.lit(""), *METRICS).alias("line"))
    rule = "-" * len(head)
    # One line a candidate of one run.
    return [rule, head, rule, *(r.line for r in rows.collect()), rule, *(r.line for r in own.collect()), rule]


def phase_summary(tiles: DataFrame, requested: int, tolerance: float) -> DataFrame:
    """One row of tiles(tile_ix, error): ok, over the tolerance, failed, mean error."""
    good = F.col("error") < tolerance
    out = tiles.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("over_tolerance"), F.count("*").alias("n"), F.avg("error").alias("mean_error"))
    return out.select("ok", "over_tolerance", (F.lit(requested) - F.col("n")).alias("failed"), "mean_error")


def valid_trials(trials: DataFrame) -> DataFrame:
    return trials.where((F.abs("error") < float("inf")) & (F.col("success_rate") > 0))


def near_one(trials: DataFrame, width: float) -> DataFrame:
    return trials.where((F.abs(F.col("node_factor") - 1) <= width) & (F.abs(F.col("edge_factor") - 1) <= width))


def combined_score(trials: DataFrame) -> DataFrame:
    """trials with ``score``: half for a low error, half for a high success rate, each scaled to its range."""
    ends = trials.agg(F.min("error").alias("e0"), F.max("error").alias("e1"), F.min("success_rate").alias("s0"), F.max("success_rate").alias("s1"))
    scaled = lambda c, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    scored = trials.join(F.broadcast(ends))  # one row
    return scored.withColumn("score", 0.5 * (1 - scaled("error", "e0", "e1")) + 0.5 * scaled("success_rate", "s0", "s1")).drop("e0", "e1", "s0", "s1")


def pareto(trials: DataFrame) -> DataFrame:
    """Trials that no other one beats: no error above, no success rate below, one of them strictly.

    One pass in order of error: a trial stays if its success rate is the best of
    its error and above that of every smaller error.
    """
    by_error = trials.groupBy("error").agg(F.max("success_rate").alias("top"))
    before = F.max("top").over(Window.orderBy("error").rowsBetween(Window.unboundedPreceding, -1))
    front = by_error.withColumn("before", before).where("before is null or top > before")
    return trials.join(front.select("error", F.col("top").alias("success_rate")), ["error", "success_rate"], "left_semi")


def top(trials: DataFrame, by: str, n: int = 15) -> DataFrame:
    order = {"error": [F.asc("error"), F.desc("success_rate")], "success_rate": [F.desc("success_rate"), F.asc("error")], "score": [F.desc("score"), F.asc("error")]}[by]
    return trials.orderBy(*order, "node_factor", "edge_factor").limit(n)
