"""Weights for grown networks from the length-weight pairs of a measured one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..session import cut
from .topology import placed_edges, population

#: Bins between order statistics at n // 3 and 2n // 3 (fixed values); up to MANY edges: linear bins.
THIRDS, LINEAR, MANY = (50, 30, 20), 100, 100
#: Observed weights that a bin holds at most.
MOST_VALUES = 4096
#: Different observations a block is made for, blocks at most (they grow beyond), lengths that one task compares with a block.
BLOCK, MOST_BLOCKS, VISITS = 4096, 1 << 14, 20_000


def length_bins(lengths: DataFrame) -> DataFrame:
    """lengths(graph_id, length) -> (graph_id, bin, lo, hi): 100 bins a graph."""
    w = Window.partitionBy("graph_id").orderBy("length")
    ranked = lengths.select("graph_id", "length", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("graph_id")).alias("n"))
    at = lambda i: F.max(F.when(F.col("k") == i + 1, F.col("length")))
    s = ranked.groupBy("graph_id", "n").agg(F.min("length").alias("lo"), F.max("length").alias("hi"), at(F.floor(F.col("n") / 3)).alias("t1"), at(F.floor(2 * F.col("n") / 3)).alias("t2"))
    run = lambda a, b, k, base: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct((i + base).alias("bin"), (F.col(a) + (F.col(b) - F.col(a)) * i / k).alias("lo"), F.when(i == k - 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (i + 1) / k).alias("hi")))
    a, b, c = THIRDS
    bins = F.when(F.col("n") > MANY, F.concat(run("lo", "t1", a, 0), run("t1", "t2", b, a), run("t2", "hi", c, a + b))).otherwise(run("lo", "hi", LINEAR, 0))
    return s.select("graph_id", F.explode(bins).alias("x")).select("graph_id", "x.bin", "x.lo", "x.hi")


def assign_bins(lengths: DataFrame, bins: DataFrame) -> DataFrame:
    """lengths with ``bin``: the last bin that begins at or below the length, clipped to the ends.

    A graph's bins are one array of 100 begins.
    """
    b = bins.groupBy("graph_id").agg(F.array_sort(F.collect_list("lo")).alias("begins"))
    k = F.size(F.filter("begins", lambda x: x <= F.col("length"))) - 1
    return lengths.join(b, "graph_id").withColumn("bin", F.greatest(F.lit(0), F.least(k, F.size("begins") - 1))).drop("begins")


def fit(net: NetworkFrame) -> DataFrame:
    """(graph_id, bin, lo, hi, weights, fallback): observed weights by length bin (MOST_VALUES of their quantiles
    where there are more), and the mean for empty ones: 100 rows of bounded size."""
    e = placed_edges(net).select("graph_id", "length", net.weights().alias("weight"))
    bins = length_bins(e)
    seen = population(assign_bins(e, bins).select("graph_id", "bin", "weight"), "weight", "weights", MOST_VALUES, "bin")
    mean = e.groupBy("graph_id").agg(F.avg("weight").alias("fallback"))
    return bins.join(seen, ["graph_id", "bin"], "left").join(mean, "graph_id").withColumn("weights", F.coalesce("weights", F.array().cast("array<double>")))


def uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def assign(net: NetworkFrame, model: DataFrame, seed: int = 0, draw: Column | None = None) -> NetworkFrame:
    """net with a random observed weight of each edge's length bin; model is ``fit`` of one graph.

    ``draw`` are numbers from 0 to below 1 of (graph_id, u, v) in place of the seeded ones.
    """
    m = model.select("bin", "lo", "weights", "fallback")
    begins = m.agg(F.array_sort(F.collect_list("lo")).alias("begins"))
    e = placed_edges(net).join(F.broadcast(begins)).withColumn("bin", F.greatest(F.lit(0), F.least(F.size(F.filter("begins", lambda x: x <= F.col("length"))) - 1, F.size("begins") - 1)))
    e = e.join(F.broadcast(m.drop("lo")), "bin", "left")  # 100 bounded rows
    u = uniform(F.lit(seed), "graph_id", "u", "v") if draw is None else draw
    w = F.when(F.size("weights") > 0, F.get("weights", F.floor(u * F.size("weights")).cast("int"))).otherwise(F.col("fallback"))
    return NetworkFrame(net.nodes, e.select("graph_id", "u", "v", w.alias("weight")), True)


def observation_blocks(seen: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """((block, length, weight, n), boxes): observations in strips of length and blocks of weight within a strip, of
    about BLOCK different ones each; equal ones are one row that counts up to k.

    boxes has a row a block: least and most length, least absolute weight, observations; at most MOST_BLOCKS rows.
    """
    each = cut(seen.groupBy("length", "weight").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")), "observations")
    strips = min(int(MOST_BLOCKS**0.5), max(1, round((each.count() / BLOCK) ** 0.5)))
    at = [i / strips for i in range(1, strips)]
    height = F.abs("weight")
    begins = each.agg(F.percentile_approx("length", at, 10_000).alias("b")).first()["b"] if at else None
    strip = F.size(F.filter(F.array(*map(F.lit, begins)), lambda x: x < F.col("length"))) if begins else F.lit(0)
    rows = each.withColumn("strip", strip)
    if at:
        rows = rows.join(rows.groupBy("strip").agg(F.percentile_approx(height, at, 10_000).alias("h")), "strip")
        rows = rows.withColumn("floor", F.size(F.filter("h", lambda x: x < height)))
    else:
        rows = rows.withColumn("floor", F.lit(0))
    blocks = cut(rows.select((F.col("strip") * strips + F.col("floor")).cast("int").alias("block"), "length", "weight", "n"), "blocks")
    box = blocks.groupBy("block").agg(F.min("length").alias("x0"), F.max("length").alias("x1"), F.min(height).alias("y0"), F.sum("n").alias("n")).orderBy("block").toPandas()
    return blocks, box.to_numpy(float)


def nearest_observations(lengths: DataFrame, seen: DataFrame, k: int = 50) -> DataFrame:
    """(length, nearest): for every different length its k nearest observations(length, weight) to (length, 0), as
    structs (d, x, weight) by distance, ties by x and weight; fewer if there are no more.

    A length first looks into the blocks of least lower bound that hold k observations
    together; the k-th distance there bounds the search, and all other blocks that begin
    within it are looked into next.  So the answer is exact, and only blocks near the point are read.
    """
    blocks, boxes = observation_blocks(seen, k)
    # One row a block: at most MOST_BLOCKS.
    shared = lengths.sparkSession.sparkContext.broadcast(boxes)

    def bounds(x: np.ndarray) -> np.ndarray:
        b = shared.value
        return np.hypot(np.maximum(0, np.maximum(b[None, :, 1] - x[:, None], x[:, None] - b[None, :, 2])), b[None, :, 3])

    def visits(batches, first: bool):
        step = max(1, (1 << 21) // max(1, len(shared.value)))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                low = bounds(part.length.to_numpy())
                order = np.argsort(low, axis=1, kind="stable")
                held = np.cumsum(shared.value[order, 4], axis=1)
                early = np.zeros(low.shape, bool)
                np.put_along_axis(early, order, (held - shared.value[order, 4]) < k, axis=1)
                # Rounding must not hide a block that begins at the bound.
                row, at = np.nonzero(early if first else ~early & (low <= part.far.to_numpy()[:, None] * (1 + 1e-12)))
                yield pd.DataFrame({"block": shared.value[at, 0].astype(np.int32), "length": part.length.to_numpy()[row]})

    def best(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"length": [], "s": [], "x": [], "weight": [], "n": []})]
        points = points.sort_values(["length", "weight"])
        x, y, n = points.length.to_numpy(), points.weight.to_numpy(), points.n.to_numpy()
        q = np.sort(rows.length.to_numpy())
        step = max(1, (1 << 20) // max(1, len(x)))
        for lo in range(0, len(q) if len(x) else 0, step):
            # Squares are compared: roots of different ones may be equal.
            s = (x - q[lo : lo + step, None]) ** 2 + y**2
            top = min(k, len(x))
            kth = np.partition(s, top - 1, axis=1)[:, top - 1 : top]
            i, j = np.nonzero(s <= kth)
            out.append(pd.DataFrame({"length": q[lo + i], "s": s[i, j], "x": x[j], "weight": y[j], "n": n[j]}))
        return pd.concat(out).astype({"n": "int64"})

    def look(at: DataFrame) -> DataFrame:
        """The best of each visited block; a block that many lengths visit is read in salted parts."""
        parts = at.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
        salted = at.join(parts, "block").withColumn("salt", F.pmod(F.xxhash64("length"), "parts").cast("int")).select("block", "salt", "length")
        copies = blocks.join(parts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "salt", "length", "weight", "n")
        keys = ["block", "salt"]
        return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(best, "length double, s double, x double, weight double, n long")

    def nearest(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("length").orderBy("s", "x", "weight")
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return found.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)

    asked = cut(lengths.select("length").distinct(), "lengths")
    seen_first = cut(nearest(look(asked.mapInPandas(lambda b: visits(b, True), "block int, length double"))), "nearest")
    far = seen_first.groupBy("length").agg(F.when(F.sum("n") >= k, F.sqrt(F.max("s"))).otherwise(float("inf")).alias("far"))
    later = cut(look(far.mapInPandas(lambda b: visits(b, False), "block int, length double")), "nearest")
    every = nearest(seen_first.drop("before").unionByName(later))
    copies = F.array_repeat(F.struct(F.sqrt("s").alias("d"), "x", "weight"), F.least(F.col("n"), k - F.col("before")).cast("int"))
    return every.groupBy("length").agg(F.array_sort(F.flatten(F.collect_list(copies))).alias("nearest"))


def assign_mixed(net: NetworkFrame, original: NetworkFrame, share: float = 0.3, k: int = 50, seed: int = 0) -> NetworkFrame:
    """As ``assign``, but a share of edges draws from the k nearest observations to (length, 0), by 1 / (distance + 1e-8)."""
    plain = assign(net, fit(original), seed)
    seen = placed_edges(original).select("length", original.weights().alias("weight"))
    lengths = placed_edges(net).select("graph_id", "u", "v", "length")
    edge = ("graph_id", "u", "v")
    chosen = uniform(F.lit(seed), F.lit("mix"), *edge) < share
    mixed = cut(lengths.where(chosen), "mixed")
    near = mixed.join(nearest_observations(mixed, seen, k), "length")
    chance = F.transform("nearest", lambda o: 1 / (o.d + 1e-8))
    total = F.aggregate(chance, F.lit(0.0), lambda a, c: a + c)
    # The first observation at which the running sum passes the drawn part of the whole.
    goal = uniform(F.lit(seed), F.lit("near"), *edge) * total
    walk = F.aggregate("nearest", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("weight")), lambda a, o: F.struct((a["sum"] + 1 / (o.d + 1e-8)).alias("sum"), F.coalesce(a.weight, F.when(a["sum"] + 1 / (o.d + 1e-8) > goal, o.weight)).alias("weight")))
    drawn = near.select(*edge, F.coalesce(walk.weight, F.element_at("nearest", -1).weight).alias("drawn"))
    e = plain.edges.join(drawn, list(edge), "left")
    return NetworkFrame(plain.nodes, e.select(*edge, F.coalesce("drawn", "weight").alias("weight")), True)
