"""Names for SQL text: predicates as SQL functions, and a table function over a network's edges.

    SELECT * FROM sp_histogram(TABLE(edges) PARTITION BY graph_id)

``edges`` holds (graph_id, u, v); the rows are those of ``paths.balls``: how many
nodes lie at each hop distance of every node.  A partition is one graph, held by one task.
Where ``edges`` has the flags ``u_asked`` and ``v_asked`` too, only nodes with a flag that is
true get rows (all edges still count); so a filter on ``src`` needs not wait for all sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators import kernels as K

#: name(arguments) -> SQL text that Spark puts in place of a call.
_SIDE = "signum(({1}x - {0}x) * ({2}y - {0}y) - ({1}y - {0}y) * ({2}x - {0}x))"
_IN_BOX = "{2}x BETWEEN least({0}x, {1}x) AND greatest({0}x, {1}x) AND {2}y BETWEEN least({0}y, {1}y) AND greatest({0}y, {1}y)"


def _segments() -> str:
    """Segments ab and cd share a point: their ends lie on different sides of each other, or an end lies on the other one."""
    pairs = (("a", "b", "c"), ("a", "b", "d"), ("c", "d", "a"), ("c", "d", "b"))
    apart = f"{_SIDE.format(*pairs[0])} * {_SIDE.format(*pairs[1])} < 0 AND {_SIDE.format(*pairs[2])} * {_SIDE.format(*pairs[3])} < 0"
    return " OR ".join([f"({apart})", *(f"({_SIDE.format(*p)} = 0 AND {_IN_BOX.format(*p)})" for p in pairs)])


FUNCTIONS = {
    "segments_intersect": (", ".join(f"{p}{c} DOUBLE" for p in "abcd" for c in "xy"), "BOOLEAN", _segments()),
    "within_frame": ("x DOUBLE, y DOUBLE, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE", "BOOLEAN", "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"),
    "polar_x": ("x DOUBLE, degrees DOUBLE, distance DOUBLE", "DOUBLE", "x + distance * cos(radians(degrees))"),
    "polar_y": ("y DOUBLE, degrees DOUBLE, distance DOUBLE", "DOUBLE", "y + distance * sin(radians(degrees))"),
}


class SpHistogram:
    """Hop histograms of one graph: gathers its edges, then goes through its nodes in chunks."""

    CHUNK = 512

    def __init__(self) -> None:
        self.edges: list[pa.RecordBatch] = []

    def eval(self, edges: pa.RecordBatch) -> Iterator[pa.Table]:
        self.edges.append(edges)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.edges:
            return
        t = pa.Table.from_batches(self.edges)
        u, v = t["u"].to_numpy(), t["v"].to_numpy()
        g = K.Csr(np.concatenate([u, v]), u, v)
        asked = np.arange(g.n)
        if "u_asked" in t.column_names:
            asked = np.searchsorted(g.ids, np.unique(np.concatenate([ends.filter(t[f"{c}_asked"]).to_numpy() for c, ends in (("u", t["u"]), ("v", t["v"]))])))
        for at in range(0, len(asked), self.CHUNK):
            sources = asked[at : at + self.CHUNK]
            cnt = K.hop_counts(g, sources)
            i, r = np.nonzero(cnt)
            graph = pa.repeat(t["graph_id"][0], len(i))
            yield pa.table({"graph_id": graph, "src": g.ids[sources[i]], "r": r + 1.0, "cnt": cnt[i, r]})


def register(spark: SparkSession) -> None:
    for name, (arguments, kind, text) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {text}")
    spark.udtf.register("sp_histogram", arrow_udtf(SpHistogram, returnType="graph_id string, src long, r double, cnt long"))
