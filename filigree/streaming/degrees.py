"""Degrees kept up over a stream of added and removed edges, as state of nodes.

A change (graph_id, u, v, change) adds (+1) or removes (-1) one edge between two nodes.
A node's state holds for every other end how many edges are left, and the
number of updates that it has sent; sums don't hang on the order of changes, so
a removal may come before what it removes.  A batch's changes of one node and
neighbour are summed before they reach the state.  With ``keep`` seconds of
event time an edge's end that was last touched longer ago is forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "graph_id string, u long, v long, change int"
DEGREES = "graph_id string, node_id long, version long, degree long, edges long"


#: Neighbours of a node that its block's value holds; of a node with more, each is an entry of a map.
FEW = 256
#: Nodes whose ids differ in so many last bits only are one block.
BLOCK = 6


class Degrees(StatefulProcessor):
    """State a (graph_id, block): for its nodes the updates sent so far, and other end -> edges left.

    A call to the state costs more than its contents, so a block of neighbouring ids is read and written as one value.
    Nodes that get more than FEW neighbours have them in a map, of which a batch touches only what it changes.
    """

    VALUE = "nodes array<long>, version array<long>, degree array<long>, edges array<long>, many array<boolean>, owner array<long>, other array<long>, n array<long>, touched array<long>"

    def __init__(self, keep: int | None = None, few: int = FEW):
        self.keep, self.few = keep, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getMapState("near", "node long, other long", "n long, touched long")
        self.block = handle.getValueState("block", self.VALUE)

    def _read(self) -> tuple[dict[int, list], dict[int, dict[int, tuple[int, int]]]]:
        """node -> [updates sent, degree, edges, are its neighbours in the map]; node -> its neighbours if not."""
        nodes, version, degree, edges, many, owner, other, n, touched = self.block.get() or ([],) * 9
        stand = {k: list(x) for k, *x in zip(nodes, version, degree, edges, many)}
        near: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in nodes}
        for k, o, *held in zip(owner, other, n, touched):
            near[k][o] = tuple(held)
        return stand, near

    def _write(self, graph: str, stand: dict, near: dict, was: dict) -> Iterator[Row]:
        """Keeps the block; sends the nodes that stand otherwise than they ``was``."""
        for node, before in was.items():
            if before != stand[node][1:3] or not stand[node][0]:
                stand[node][0] += 1
                yield Row(graph_id=graph, node_id=node, version=stand[node][0], degree=stand[node][1], edges=stand[node][2])
        rows = [(k, o, *held) for k, of in near.items() for o, held in of.items()]
        self.block.update((list(stand), *(list(c) for c in zip(*stand.values())), *([r[i] for r in rows] for i in range(4))))

    def _set(self, stand: dict, near: dict, node: int, other: int, held: tuple[int, int] | None, after: tuple[int, int] | None) -> None:
        """Puts ``after`` in place of what is held of a neighbour, None being nothing."""
        if stand[node][3]:
            if after:
                self.near.updateValue((node, other), after)
            elif held:
                self.near.removeKey((node, other))
        elif after:
            near[node][other] = after
        else:
            near[node].pop(other, None)
        n, m = held[0] if held else 0, after[0] if after else 0
        stand[node][1] += (m > 0) - (n > 0)
        stand[node][2] += max(m, 0) - max(n, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        change: dict[tuple[int, int], int] = {}
        for r in rows:
            change[r.node_id, r.other] = change.get((r.node_id, r.other), 0) + r.change
        time = timerValues.getCurrentWatermarkInMs() if self.keep else 0
        stand, near = self._read()
        was = {}
        for (node, other), k in change.items():
            if node not in stand:
                stand[node], near[node] = [0, 0, 0, False], {}
            was.setdefault(node, stand[node][1:3])
            if stand[node][3]:
                held = self.near.getValue((node, other)) if self.near.containsKey((node, other)) else None
            else:
                held = near[node].get(other)
            after = (held[0] if held else 0) + k
            self._set(stand, near, node, other, held, (after, time) if after or self.keep else None)
            if len(near[node]) > self.few:
                for o, of in near[node].items():
                    self.near.updateValue((node, o), of)
                stand[node][3], near[node] = True, {}
        if self.keep:
            self.handle.registerTimer(time + 1000 * self.keep)
        yield from self._write(key[0], stand, near, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = expiredTimerInfo.getExpiryTimeInMs() - 1000 * self.keep
        stand, near = self._read()
        was = {node: x[1:3] for node, x in stand.items()}
        old = [(node, o, held) for node, of in near.items() for o, held in of.items()]
        if any(x[3] for x in stand.values()):
            old += [(*k, tuple(held)) for k, held in self.near.iterator()]
        for node, other, held in old:
            if held[1] <= limit:
                self._set(stand, near, node, other, held, None)
        yield from self._write(key[0], stand, near, was)

    def close(self) -> None:
        pass


def degree_updates(changes: DataFrame, keep: int | None = None, at: str = "ts") -> DataFrame:
    """DEGREES rows, one whenever a batch of a stream of CHANGES alters a node; a loop counts once.

    The row with a node's greatest version is how it stands. With ``keep`` the stream has an event time ``at`` and a watermark.
    """
    more = [at] if keep else []
    both = changes.select(F.explode(F.when(F.col("u") == F.col("v"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).alias("e"), "graph_id", F.col("change").cast("long").alias("change"), *more)
    rows = both.select("graph_id", F.shiftright("e.u", BLOCK).alias("block"), F.col("e.u").alias("node_id"), F.col("e.v").alias("other"), "change", *more)
    return rows.groupBy("graph_id", "block").transformWithState(Degrees(keep), DEGREES, "Update", "EventTime" if keep else "None")


def standing(updates: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree, edges) of collected updates."""
    last = F.max(F.struct("version", "degree", "edges")).alias("l")
    return updates.groupBy("graph_id", "node_id").agg(last).select("graph_id", "node_id", "l.degree", "l.edges")


def with_state_store(spark) -> None:
    """State of this kind lives in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
