"""Degree, length and angle statistics, subgraphs and frames; grouped by graph_id throughout."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..functions import geometry as G
from ..functions.numeric import py_round, ratio
from ..session import cut, spread

#: Pairs of a cell's edges that one task looks at.
CELL_PAIRS = 1 << 26


def counts(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_count, edge_count)"""
    n = net.nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"))
    m = net.edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"))
    return n.join(m, "graph_id", "left").select("graph_id", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def degrees(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_id, degree, strength) of all nodes; a loop counts twice."""
    s = net.both_ways().groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count("*").alias("degree"), F.sum(net.weights()).alias("strength"))
    out = net.nodes.select("graph_id", "node_id").join(s, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def degree_distribution(net: NetworkFrame) -> DataFrame:
    """(graph_id, degree, n, share)"""
    d = degrees(net).groupBy("graph_id", "degree").agg(F.count("*").alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("graph_id")))


def _ends(net: NetworkFrame, deg: DataFrame) -> DataFrame:
    one = lambda c: deg.select("graph_id", F.col("node_id").alias(c), F.col("degree").alias(f"degree_{c}"))
    return net.both_ways().join(one("u"), ["graph_id", "u"]).join(one("v"), ["graph_id", "v"])


def degree_transitions(net: NetworkFrame) -> DataFrame:
    """(graph_id, degree_u, degree_v, n, prob): each edge in both directions."""
    t = _ends(net, degrees(net)).groupBy("graph_id", "degree_u", "degree_v").agg(F.count("*").alias("n"))
    return t.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("graph_id", "degree_u")))


def placed_edges(net: NetworkFrame, both: bool = False) -> DataFrame:
    """Edges with end positions, length and direction."""
    at = lambda c, s: net.nodes.select("graph_id", F.col("node_id").alias(c), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"))
    e = (net.both_ways() if both else net.edges).join(at("u", 1), ["graph_id", "u"]).join(at("v", 2), ["graph_id", "v"])
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return e.withColumns({"length": G.length(*ends), "angle": G.angle(*ends)})


def degree_lengths(net: NetworkFrame, most: int | None = None, counts: bool = False) -> DataFrame:
    """(graph_id, degree, lengths): each edge's length at both its ends."""
    d = degrees(net).select("graph_id", F.col("node_id").alias("u"), "degree")
    all_ = placed_edges(net, both=True).join(d, ["graph_id", "u"]).select("graph_id", "degree", "length")
    return counted(all_, "length", "lengths") if counts else population(all_, "length", "lengths", most)


def angle_gaps(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_id, seq, gap): circular gaps between neighbour directions, nodes with two or more."""
    w = Window.partitionBy("graph_id", "u").orderBy("angle", "v")
    whole = Window.partitionBy("graph_id", "u")
    e = placed_edges(net, both=True).withColumns({"seq": F.row_number().over(w), "n": F.count("*").over(whole), "next": F.lead("angle").over(w), "first": F.min("angle").over(whole)})
    gap = F.when(F.col("next").isNotNull(), F.col("next") - F.col("angle")).otherwise(360.0 + F.col("first") - F.col("angle"))
    return e.where("n > 1").select("graph_id", F.col("u").alias("node_id"), "seq", gap.alias("gap"))


def degree_angles(net: NetworkFrame, most: int | None = None, counts: bool = False) -> DataFrame:
    """(graph_id, degree, angles): the gaps by degree of their node."""
    all_ = angle_gaps(net).join(degrees(net), ["graph_id", "node_id"]).select("graph_id", "degree", "gap")
    return counted(all_, "gap", "angles") if counts else population(all_, "gap", "angles", most)


def population(df: DataFrame, value: str, name: str, most: int | None, by: str = "degree") -> DataFrame:
    """df(graph_id, by, value) -> (graph_id, by, name): the sorted values of a degree, or ``most`` evenly spread
    quantiles of them where there are more, so that a row is bounded."""
    key = ["graph_id", by]
    if most is None:
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(name))
    n = df.groupBy(*key).agg(F.count("*").alias("n"))
    sized = df.join(n, key)
    few = sized.where(F.col("n") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(name))
    many = sized.where(F.col("n") > most).groupBy(*key).agg(F.percentile_approx(value, [(i + 0.5) / most for i in range(most)], 10 * most).alias(name))
    return few.unionByName(many)


def counted(df: DataFrame, value: str, name: str, by: str = "degree") -> DataFrame:
    """df(graph_id, by, value) -> (graph_id, by, name): the distinct values of a degree ascending, and how many of all its values
    are no greater: what its sorted values are, without their repetitions."""
    key = ["graph_id", by]
    n = df.groupBy(*key, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ends = n.select(*key, F.struct("value", F.sum("n").over(Window.partitionBy(*key).orderBy("value")).alias("end")).alias("e"))
    rows = ends.groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select(*key, F.struct(F.col("e.value").alias("values"), F.col("e.end").alias("ends")).alias(name))


def attributes(net: NetworkFrame, most: int | None = None, counts_of_values: bool = False) -> DataFrame:
    """One row a graph: distributions and samples as maps, average length and degree; empty maps and 0.0 for an empty graph.

    ``most`` bounds the samples of a degree (quantiles stand for more of them); with ``counts_of_values`` they are as ``counted`` gives them.
    """
    entries = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(k).cast("int"), F.col(v)))))
    dist = degree_distribution(net).groupBy("graph_id").agg(entries("degree", "share").alias("degree_distribution"))
    inner = degree_transitions(net).groupBy("graph_id", "degree_u").agg(entries("degree_v", "prob").alias("row"))
    trans = inner.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("degree_u").cast("int"), F.col("row")))).alias("degree_transition_probs"))
    lengths = degree_lengths(net, most, counts_of_values).groupBy("graph_id").agg(entries("degree", "lengths").alias("degree_lengths"))
    angles = degree_angles(net, most, counts_of_values).groupBy("graph_id").agg(entries("degree", "angles").alias("degree_angles"))
    mean = placed_edges(net).groupBy("graph_id").agg(F.avg("length").alias("average_length"))
    n = counts(net).select("graph_id", ratio(2 * F.col("edge_count"), F.col("node_count")).alias("average_degree"))
    out = n
    for part in (dist, trans, lengths, angles, mean):
        out = out.join(part, "graph_id", "left")
    return out.withColumn("average_length", F.coalesce("average_length", F.lit(0.0)))


def triangles(net: NetworkFrame) -> DataFrame:
    """(graph_id, a, b, c, wab, wbc, wac) with a < b < c; simple edges.

    Every edge points to its end of larger degree (then larger id), so a node's pairs of
    heads number at most the edges of the graph times two, a hub's as well.
    """
    e = net.edges.where("u <> v").select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), net.weights().alias("w")).dropDuplicates(["graph_id", "u", "v"])
    degree = e.select("graph_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("k"))
    end = lambda c: degree.select("graph_id", F.col("node_id").alias(c), F.col("k").alias(f"k{c}"))
    placed = e.join(end("u"), ["graph_id", "u"]).join(end("v"), ["graph_id", "v"])
    up = F.struct("ku", "u") < F.struct("kv", "v")
    out = placed.select("graph_id", F.when(up, F.col("u")).otherwise(F.col("v")).alias("t"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("h"), "w")
    head = lambda h, w: out.select("graph_id", "t", F.col("h").alias(h), F.col("w").alias(w))
    wedge = head("p", "wp").join(head("q", "wq"), ["graph_id", "t"]).where("p < q")
    found = wedge.join(e.select("graph_id", F.col("u").alias("p"), F.col("v").alias("q"), F.col("w").alias("wpq")), ["graph_id", "p", "q"])
    t, p, q = (F.col(c) for c in "tpq")
    side = lambda first, middle, last: F.when(t < p, F.col(first)).when(t < q, F.col(middle)).otherwise(F.col(last))
    return found.select(
        "graph_id", F.least(t, p).alias("a"), side("p", "t", "q").alias("b"), F.greatest(t, q).alias("c"),
        side("wp", "wp", "wpq").alias("wab"), side("wpq", "wq", "wq").alias("wbc"), side("wq", "wpq", "wp").alias("wac"),
    )


def clustering(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_id, clustering): closed share of neighbour pairs; 0 under degree 2."""
    return _corner_sum(net, F.lit(1.0), "clustering")


def clustering_onnela(net: NetworkFrame) -> DataFrame:
    """Geometric-mean clustering with weights over the graph's largest."""
    return _corner_sum(net, F.cbrt(F.col("wab") * F.col("wbc") * F.col("wac")) / F.col("top"), "clustering")


def _corner_sum(net: NetworkFrame, value: Column, name: str) -> DataFrame:
    t = triangles(net)
    top = net.edges.groupBy("graph_id").agg(F.max(net.weights()).alias("top"))
    t = t.join(top, "graph_id").select("graph_id", F.explode(F.array("a", "b", "c")).alias("node_id"), value.alias("s"))
    s = t.groupBy("graph_id", "node_id").agg(F.sum("s").alias("s"))
    d = degrees(net).join(s, ["graph_id", "node_id"], "left")
    k = F.col("degree")
    return d.select("graph_id", "node_id", F.when(k > 1, 2 * F.coalesce("s", F.lit(0.0)) / (k * (k - 1))).otherwise(0.0).alias(name))


def assortativity(net: NetworkFrame) -> DataFrame:
    """(graph_id, assortativity): correlation of end degrees over both orientations; 0.0 when constant."""
    spread = F.stddev_pop("degree_u") * F.stddev_pop("degree_v")
    e = _ends(net, degrees(net)).groupBy("graph_id").agg(F.try_divide(F.covar_pop("degree_u", "degree_v"), spread).alias("r"))
    out = counts(net).select("graph_id").join(e, "graph_id", "left")
    return out.select("graph_id", F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")).alias("assortativity"))


def metrics(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_count, avg_degree, avg_clustering, avg_length, avg_angle)"""
    c = counts(net).select("graph_id", "node_count", ratio(2 * F.col("edge_count"), F.col("node_count")).alias("avg_degree"))
    parts = (
        clustering(net).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering")),
        placed_edges(net).groupBy("graph_id").agg(F.avg("length").alias("avg_length")),
        angle_gaps(net).groupBy("graph_id").agg(F.avg("gap").alias("avg_angle")),
    )
    for p in parts:
        c = c.join(p, "graph_id", "left")
    return c.fillna(0.0, ["avg_clustering", "avg_length", "avg_angle"])


def induced(net: NetworkFrame, keep: DataFrame, renumber: bool = False) -> NetworkFrame:
    """The subgraph on keep(graph_id, node_id); ``renumber`` gives ids 0.. in order of the old ones."""
    k = keep.select("graph_id", "node_id").distinct()
    nodes = net.nodes.join(k, ["graph_id", "node_id"], "left_semi")
    e = net.edges
    for c in ("u", "v"):
        e = e.join(k.withColumnRenamed("node_id", c), ["graph_id", c], "left_semi")
    if renumber:
        ids = nodes.withColumn("new", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1)
        for c in ("u", "v"):
            e = e.join(ids.select("graph_id", F.col("node_id").alias(c), F.col("new").cast("long").alias(f"new_{c}")), ["graph_id", c])
        e = e.select("graph_id", F.col("new_u").alias("u"), F.col("new_v").alias("v"), "weight")
        nodes = ids.select("graph_id", F.col("new").cast("long").alias("node_id"), "x", "y")
    return replace(net, nodes=nodes, edges=e.select("graph_id", "u", "v", "weight"))


def frame(net: NetworkFrame, width: float, height: float, digits: int = 2) -> DataFrame:
    """(graph_id, x0, x1, y0, y1) of the given size about the mean position."""
    c = net.nodes.groupBy("graph_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = lambda v: py_round(v, digits)
    return c.select("graph_id", r(F.col("cx") - width / 2).alias("x0"), r(F.col("cx") + width / 2).alias("x1"), r(F.col("cy") - height / 2).alias("y0"), r(F.col("cy") + height / 2).alias("y1"))


def crop(net: NetworkFrame, frames: DataFrame) -> NetworkFrame:
    """Nodes inside their graph's frame and the edges among them."""
    inside = net.nodes.join(frames, "graph_id").where(G.within_frame(*(F.col(c) for c in ("x", "y", "x0", "x1", "y0", "y1"))))
    return induced(net, inside)


def oriented(net: NetworkFrame, how: str) -> NetworkFrame:
    box = net.nodes.groupBy("graph_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x, y = G.orient(*(F.col(c) for c in ("x", "y", "x0", "x1", "y0", "y1")), how)
    return replace(net, nodes=net.nodes.join(box, "graph_id").select("graph_id", "node_id", x.alias("x"), y.alias("y")))


def transposed(net: NetworkFrame) -> NetworkFrame:
    return replace(net, nodes=net.nodes.select("graph_id", "node_id", F.col("y").alias("x"), F.col("x").alias("y")))


def trim_round(net: NetworkFrame, target: DataFrame, slack: float = 1.1) -> NetworkFrame:
    """One trimming round: graphs above slack * target average degree keep their int(slack * target * n / 2)
    edges with the least larger end degree; ties go to the smaller (u, v). target(graph_id, target_degree)."""
    d = degrees(net)
    one = lambda c: d.select("graph_id", F.col("node_id").alias(c), F.col("degree").alias(f"d{c}"))
    e = net.edges.join(one("u"), ["graph_id", "u"]).join(one("v"), ["graph_id", "v"]).withColumn("score", F.greatest("du", "dv"))
    size = counts(net).join(target, "graph_id")
    size = size.withColumn("keep", F.when(2 * F.col("edge_count") / F.col("node_count") > slack * F.col("target_degree"), F.floor(slack * F.col("target_degree") * F.col("node_count") / 2)).otherwise(F.col("edge_count")))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("score", "u", "v"))
    e = e.withColumn("rank", rank).join(size.select("graph_id", "keep"), "graph_id").where("rank <= keep")
    return replace(net, edges=e.select("graph_id", "u", "v", "weight"))


def every_kth(net: NetworkFrame, most: int) -> NetworkFrame:
    """Every k-th edge in order of (u, v), k being how often ``most`` goes into the number of edges, one at least."""
    m = counts(net).select("graph_id", F.greatest(F.lit(1), F.floor(F.col("edge_count") / most)).alias("k"))
    at = F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v")) - 1
    e = net.edges.withColumn("at", at).join(m, "graph_id").where(F.col("at") % F.col("k") == 0)
    return replace(net, edges=e.select("graph_id", "u", "v", "weight"))


def range_pairs(nodes: DataFrame, radius: float) -> DataFrame:
    """(graph_id, a, b, distance): pairs closer than ``radius``, through a grid of cells of that size."""
    n = nodes.withColumns({"cx": G.cell(F.col("x"), radius), "cy": G.cell(F.col("y"), radius)})
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = n.select("graph_id", F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    spread = spread.withColumn("cx", F.explode(F.transform(near, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(near, lambda k: F.col("cy") + k)))
    j = n.join(spread, ["graph_id", "cx", "cy"]).where(F.col("node_id") < F.col("b"))
    d = G.length(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return j.withColumn("distance", d).where(F.col("distance") < radius).select("graph_id", F.col("node_id").alias("a"), "b", "distance")


def crossings(net: NetworkFrame, size: float) -> DataFrame:
    """(graph_id, u1, v1, u2, v2): edges without a common end that meet, through the grid cells of their boxes.

    A pair is looked at in one cell alone, the first that both boxes have, so what is found is not gathered again.
    """
    cols = ["u", "v", "x1", "y1", "x2", "y2"]
    e = placed_edges(net).where("u <> v").select("graph_id", *cols).distinct()
    low = lambda a, b: G.cell(F.least(a, b), size)
    span = lambda a, b: F.sequence(low(a, b), G.cell(F.greatest(a, b), size))
    cells = e.withColumns({"lx": low("x1", "x2"), "ly": low("y1", "y2")}).withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    key = ["graph_id", "cx", "cy"]
    # A full cell's edges are dealt to several tasks, each of which meets all edges of the cell.
    parts = cells.groupBy(*key).agg(F.ceil(F.count("*") * F.count("*") / CELL_PAIRS).cast("int").alias("parts"))
    cells = cut(cells.join(parts, key), "cells")
    side = lambda df, s: df.select(*key, "part", *(F.col(c).alias(f"{s}_{c}") for c in (*cols, "lx", "ly")))
    a = side(cells.withColumn("part", F.pmod(F.xxhash64("u", "v"), "parts").cast("int")), "a")
    b = side(cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    key.append("part")
    j = spread(a, *key).join(spread(b, *key).hint("shuffle_hash"), key).where("(a_u < b_u or (a_u = b_u and a_v < b_v)) and cx = greatest(a_lx, b_lx) and cy = greatest(a_ly, b_ly)")
    free = (F.col("a_u") != F.col("b_u")) & (F.col("a_u") != F.col("b_v")) & (F.col("a_v") != F.col("b_u")) & (F.col("a_v") != F.col("b_v"))
    ends = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2"))
    hit = j.where(free & G.segments_intersect(ends("a"), ends("b")))
    return hit.select("graph_id", F.col("a_u").alias("u1"), F.col("a_v").alias("v1"), F.col("b_u").alias("u2"), F.col("b_v").alias("v2"))


def nearest_other(nodes: DataFrame, size: float) -> DataFrame:
    """(graph_id, node_id, distance) to the nearest other node: rings of grid cells, wider until settled.

    A node is settled when its nearest neighbour found lies within the ring
    searched; the others go on with doubled cells.
    """
    n = nodes.select("graph_id", "node_id", "x", "y")
    # A node alone in its graph has no other; the rest are settled as soon as a ring spans their graph.
    company = n.groupBy("graph_id").agg(F.count("*").alias("k")).where("k > 1").select("graph_id")
    todo, done, radius = n.join(company, "graph_id", "left_semi"), None, size
    while True:
        # One written table a ring: a compressed one passes for small, and a join with it would go through the driver.
        met = cut(_ring(todo, n, radius), "rings")
        near = F.coalesce(F.col("distance") <= radius, F.lit(False))
        found = met.where(near).select("graph_id", "node_id", "distance")
        done = found if done is None else done.unionByName(found)
        todo = met.where(~near).select("graph_id", "node_id", "x", "y")
        if todo.isEmpty():
            return done
        radius *= 4


def _ring(some: DataFrame, every: DataFrame, radius: float) -> DataFrame:
    """some(graph_id, node_id, x, y) with the distance to the nearest other node in the cells around, null without one."""
    near = F.sequence(F.lit(-1), F.lit(1))
    s = some.withColumns({"cx": G.cell(F.col("x"), radius), "cy": G.cell(F.col("y"), radius)})
    s = s.withColumn("cx", F.explode(F.transform(near, lambda k: F.col("cx") + k))).withColumn("cy", F.explode(F.transform(near, lambda k: F.col("cy") + k)))
    o = every.select("graph_id", F.col("node_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), G.cell(F.col("x"), radius).alias("cx"), G.cell(F.col("y"), radius).alias("cy"))
    j = s.join(o.hint("merge"), ["graph_id", "cx", "cy"], "left")
    d = F.when(F.col("node_id") != F.col("o"), G.length(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    return j.groupBy("graph_id", "node_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min(d).alias("distance"))
