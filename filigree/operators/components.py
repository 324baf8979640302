"""Connected components, the largest one, and trimming that depends on it."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..session import cut
from .kernels import smallest_reachable, trimmed
from .topology import counts, crop, induced, trim_round

#: Edges of one graph that a task may hold; larger graphs go through joins.
LOCAL_EDGES = 2_000_000
#: Rows that leave a task at once.
STARS = 1 << 16


def components(net: NetworkFrame) -> DataFrame:
    """(graph_id, node_id, label): the smallest node id reachable.

    Graphs that fit a task are settled there, one each.  A larger one's edges are dealt by ranges of ids and settled
    range by range; what is left are the links between components of different ranges that share a node, which are settled alike.
    """
    links = cut(net.edges.where("u <> v").select("graph_id", "u", "v"), "links")
    size = links.groupBy("graph_id").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > LOCAL_EDGES).select("graph_id")
    ids = net.nodes.select("graph_id", "node_id")
    if large.isEmpty():
        return _labelled(ids, links.groupBy("graph_id").applyInPandas(_settled, "graph_id string, node_id long, label long"))
    some = links.join(F.broadcast(large), "graph_id")  # few graphs are that large
    rest = links.join(F.broadcast(large), "graph_id", "left_anti").groupBy("graph_id").applyInPandas(_settled, "graph_id string, node_id long, label long")
    return _labelled(ids, rest.unionByName(_by_ranges(some)))


def _labelled(ids: DataFrame, found: DataFrame) -> DataFrame:
    return ids.join(found, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("label", "node_id").alias("label"))


def _settled(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    ids, label = smallest_reachable(edges.u.to_numpy(), edges.v.to_numpy())
    return pd.DataFrame({"graph_id": key[0], "node_id": ids, "label": label})


def _by_ranges(links: DataFrame) -> DataFrame:
    """(graph_id, node_id, label) of all ends of the links: each node takes the least of its ranges' labels, and labels that
    meet at a node are links of a smaller graph."""

    def settle(batches):
        held: dict[str, tuple[list, list]] = {}

        def thin(g: str) -> tuple[np.ndarray, np.ndarray]:
            ids, label = smallest_reachable(*(np.concatenate(c) for c in held[g]))
            held[g] = ([label], [ids])
            return ids, label

        for batch in batches:
            for g, part in batch.groupby("graph_id", sort=False):
                u, v = held.setdefault(g, ([], []))
                u.append(part.u.to_numpy())
                v.append(part.v.to_numpy())
                # Stars of what came before stand for it.
                if sum(map(len, u[1:])) > max(LOCAL_EDGES // 4, len(u[0])):
                    thin(g)
        for g in held:
            ids, label = thin(g)
            for lo in range(0, len(ids), STARS):
                yield pd.DataFrame({"graph_id": g, "node_id": ids[lo : lo + STARS], "label": label[lo : lo + STARS]})

    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // max(1, LOCAL_EDGES)))
    stars = cut(links.repartitionByRange(parts, "graph_id", "u").mapInPandas(settle, "graph_id string, node_id long, label long"), "stars")
    met = stars.groupBy("graph_id", "node_id").agg(F.min("label").alias("low"), F.collect_set("label").alias("labels"))
    met = cut(met.select("graph_id", "node_id", "low", F.filter("labels", lambda x: x != F.col("low")).alias("others")), "met")
    bridges = cut(met.select("graph_id", F.col("low").alias("u"), F.explode("others").alias("v")).distinct(), "bridges")
    if bridges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_EDGES).isEmpty():
        found = bridges.groupBy("graph_id").applyInPandas(_settled, "graph_id string, node_id long, label long")
    else:
        found = _hooked(bridges)
    found = cut(found, "labels").withColumnRenamed("node_id", "low")
    return met.join(found, ["graph_id", "low"], "left").select("graph_id", "node_id", F.coalesce("label", "low").alias("label"))


def _hooked(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Every node takes the smallest label next to its component, then the label of its label; the rounds grow
    with the log of the diameter, each is written, and the loop ends when nothing moves."""
    both = cut(links.unionByName(links.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    label = both.select("graph_id", F.col("u").alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    for _ in range(most_rounds):
        near = both.join(label.withColumnsRenamed({"node_id": "v", "label": "m"}), ["graph_id", "v"]).groupBy("graph_id", F.col("u").alias("node_id")).agg(F.min("m").alias("m"))
        seen = label.join(near, ["graph_id", "node_id"]).select("graph_id", "node_id", F.col("label").alias("old"), F.least("label", "m").alias("m"))
        hook = seen.groupBy("graph_id", "old").agg(F.min("m").alias("h"))
        moved = seen.join(hook, ["graph_id", "old"]).select("graph_id", "node_id", "old", F.least("m", "h").alias("label"))
        up = moved.select("graph_id", F.col("node_id").alias("label"), F.col("label").alias("up"))
        step = cut(moved.join(up, ["graph_id", "label"], "left").select("graph_id", "node_id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        label = step.select("graph_id", "node_id", "label")
        if step.where("label <> old").isEmpty():
            return label
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def component_sizes(net: NetworkFrame, label: DataFrame | None = None) -> DataFrame:
    """(graph_id, label, size, place): place 1 is the largest, ties to the smallest label."""
    label = components(net) if label is None else label
    s = label.groupBy("graph_id", "label").agg(F.count("*").alias("size"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("size"), "label")))


def connectivity(net: NetworkFrame, top: int = 5) -> DataFrame:
    """(graph_id, n_components, lcc_share, top_sizes, connected)"""
    s = component_sizes(net)
    return s.groupBy("graph_id").agg(
        F.count("*").alias("n_components"),
        (F.max("size") / F.sum("size")).alias("lcc_share"),
        F.slice(F.reverse(F.array_sort(F.collect_list("size"))), 1, top).alias("top_sizes"),
        (F.count("*") <= 1).alias("connected"),
    )


def largest_component(net: NetworkFrame, renumber: bool = False) -> NetworkFrame:
    label = components(net)
    best = component_sizes(net, label).where("place = 1").select("graph_id", "label")
    return induced(net, label.join(best, ["graph_id", "label"], "left_semi"), renumber)


def cropped_component(net: NetworkFrame, frames: DataFrame) -> NetworkFrame:
    """The largest component of what lies inside each graph's frame."""
    return largest_component(crop(net, frames))


def trim(net: NetworkFrame, target: DataFrame, slack: float = 1.1) -> NetworkFrame:
    """Rounds of trimming and largest component until no graph's average degree is above slack * target.

    A round takes an edge from every graph above its bound at least, so it ends.  Graphs that fit a
    task run all their rounds there, one each; with a larger one among them a round is a join.
    """
    edges = cut(net.edges.select("graph_id", "u", "v", "weight"), "edges")
    net = replace(net, edges=edges)
    goal = target.select("graph_id", F.col("target_degree").cast("double").alias("target_degree"))
    if edges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_EDGES).isEmpty():
        nodes = net.nodes.join(goal, "graph_id", "left").select("graph_id", "node_id", "target_degree")

        def run(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            ids, u, v = np.sort(nodes.node_id.to_numpy()), edges.u.to_numpy(), edges.v.to_numpy()
            inside, kept = trimmed(ids, u, v, float(nodes.target_degree.iloc[0]) if len(nodes) else math.nan, slack)
            some = pd.DataFrame({"graph_id": key[0], "node_id": ids[inside], "u": -1, "v": -1, "weight": math.nan, "edge": False})
            return pd.concat([some, edges.iloc[kept][["graph_id", "u", "v", "weight"]].assign(node_id=-1, edge=True)[some.columns]])

        schema = "graph_id string, node_id long, u long, v long, weight double, edge boolean"
        left = cut(nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, schema), "trimmed")
        weight = F.when(~F.isnan("weight"), F.col("weight"))
        return replace(net, nodes=net.nodes.join(left.where("not edge").select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi"), edges=left.where("edge").select("graph_id", "u", "v", weight.alias("weight")))
    while True:
        over = counts(net).join(goal, "graph_id").where(2 * F.col("edge_count") / F.col("node_count") > slack * F.col("target_degree"))
        if over.isEmpty():
            return net
        net = largest_component(trim_round(net, goal, slack))
        net = NetworkFrame(cut(net.nodes, "nodes"), cut(net.edges, "edges"), net.weighted)
