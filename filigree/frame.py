"""A set of undirected spatial networks as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NetworkFrame:
    """nodes(graph_id, node_id, x, y) and edges(graph_id, u, v, weight), one row an edge.

    ``weighted`` is a property of the schema: an unweighted network's weight
    column is null and reads as 1.0.
    """

    nodes: DataFrame
    edges: DataFrame
    weighted: bool = False

    def __repr__(self) -> str:
        return f"NetworkFrame(weighted={self.weighted}, nodes={self.nodes.columns}, edges={self.edges.columns})"

    def both_ways(self) -> DataFrame:
        """(graph_id, u, v, weight) with every edge in both directions; a loop stands twice."""
        back = self.edges.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), "weight")
        return self.edges.select("graph_id", "u", "v", "weight").unionByName(back)

    def weights(self) -> Column:
        return F.coalesce(F.col("weight"), F.lit(1.0))

    def edges_with_weights(self) -> DataFrame:
        return self.edges.select("graph_id", "u", "v", self.weights().alias("weight"))

    def make_weighted(self) -> NetworkFrame:
        return self if self.weighted else replace(self, edges=self.edges_with_weights(), weighted=True)

    def make_unweighted(self) -> NetworkFrame:
        return replace(self, edges=self.edges.withColumn("weight", F.lit(None).cast("double")), weighted=False) if self.weighted else self

    def inverse_weights(self) -> NetworkFrame:
        """Weights 1 / w as lengths; a weight of zero is infinitely long."""
        w = self.weights()
        return replace(self, edges=self.edges.withColumn("weight", F.when(w != 0, 1 / w).otherwise(F.lit(float("inf")))), weighted=True)

    def neighbours(self, node: int) -> DataFrame:
        return self.both_ways().where(F.col("u") == node).select("graph_id", F.col("v").alias("node_id")).distinct()

    def weight_of(self, pairs: DataFrame) -> DataFrame:
        """pairs(graph_id, u, v) with their weight: 1.0 on an unweighted edge, 0.0 where there is none."""
        lo, hi = F.least("u", "v"), F.greatest("u", "v")
        have = self.edges.select("graph_id", F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"), self.weights().alias("weight"))
        keyed = pairs.withColumns({"_a": lo, "_b": hi})
        return keyed.join(have, ["graph_id", "_a", "_b"], "left").select("graph_id", "u", "v", F.coalesce("weight", F.lit(0.0)).alias("weight"))

    def without_edges(self, pairs: DataFrame) -> NetworkFrame:
        gone = pairs.select("graph_id", F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"))
        keyed = self.edges.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
        return replace(self, edges=keyed.join(gone, ["graph_id", "_a", "_b"], "left_anti").drop("_a", "_b"))

    def with_positions(self, moved: DataFrame) -> NetworkFrame:
        """moved(graph_id, node_id, x, y) replaces positions."""
        new = moved.select("graph_id", "node_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
        nodes = self.nodes.join(new, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
        return replace(self, nodes=nodes)

    def checked(self) -> NetworkFrame:
        """Reading the edges fails on a weight that is not positive."""
        ok = F.when(F.col("weight") <= 0, F.raise_error(F.lit("non-positive weight"))).otherwise(F.col("weight"))
        return replace(self, edges=self.edges.withColumn("weight", ok)) if self.weighted else self


def canonical(edges: DataFrame, keep: str = "any", loops: bool = False, order: str = "edge_ix") -> DataFrame:
    """One row an unordered pair: the first or last one's weight by ``order``, or without weights."""
    e = edges if loops else edges.where("u <> v")
    e = e.withColumns({"_a": F.least("u", "v"), "_b": F.greatest("u", "v")})
    if keep == "any":
        return e.select("graph_id", F.col("_a").alias("u"), F.col("_b").alias("v")).distinct().withColumn("weight", F.lit(None).cast("double"))
    pick = F.min_by if keep == "first" else F.max_by
    return e.groupBy("graph_id", F.col("_a").alias("u"), F.col("_b").alias("v")).agg(pick("weight", order).alias("weight"))


def from_matrix(nodes: DataFrame, cells: DataFrame) -> NetworkFrame:
    """cells(graph_id, u, v, weight, edge_ix): loops go, the first cell of a pair wins; always weighted."""
    return NetworkFrame(nodes, canonical(cells, "first"), True).checked()


def from_edge_list(nodes: DataFrame, edges: DataFrame) -> NetworkFrame:
    """Loops stay; pairs once; unweighted."""
    return NetworkFrame(nodes, canonical(edges, "any", loops=True), False)


def from_positions(nodes: DataFrame, segments: DataFrame) -> NetworkFrame:
    """segments(graph_id, x1, y1, x2, y2) resolved by exact position; unknown ends and loops go."""
    at = lambda s: nodes.select("graph_id", F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"), F.col("node_id").alias("uv"[s - 1]))
    e = segments.join(at(1), ["graph_id", "x1", "y1"]).join(at(2), ["graph_id", "x2", "y2"])
    return NetworkFrame(nodes, canonical(e), False)
