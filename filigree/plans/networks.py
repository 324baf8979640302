"""Networks derived from the star-schema tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import NetworkFrame
from ..session import cut

#: Vectors of a block of the neighbour search at most, blocks where they would be smaller, and vectors of a part that gives first bounds.
MOST, BLOCKS, PART = 49_152, 16, 8192
#: Vectors whose distances to a block are held at once; distances of which only the least is compared at first; columns of a tile.
ROWS, LANES, TILE = 512, 64, 1024
#: Vectors that are sent as one row; pairs that are kept before they are cut to the best, and whose distances are taken at once.
PACK, KEPT, PAIRS = 256, 1 << 20, 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest_vectors(vectors: DataFrame, k: int, blocks: int | None = None, part: int = PART) -> DataFrame:
    """vectors(id, v) -> (u, v, distance, rank): the k nearest others by distance (6 decimals), ties to the smaller id.

    Small parts give every vector a bound, the distance of its k-th nearest there. Then two blocks are a task, which takes
    the product of two vectors once for both and keeps about k candidates a row within its bound; a window keeps the
    best of a row's.
    """
    n = vectors.count()
    parts = max(1, -(-n // part))
    blocks = blocks or max(-(-n // MOST), min(BLOCKS, parts))
    hashed, schema = F.xxhash64("id"), "u long, v long, distance double"

    def packed(df: DataFrame, group: Column, size: int, *more: str) -> DataFrame:
        pack = F.pmod(F.shiftright(hashed, 20), F.lit(max(1, -(-size // PACK))))
        rows = df.groupBy(group.cast("int").alias("block"), pack.alias("pack")).agg(F.collect_list(F.struct("id", "v", *more)).alias("r"))
        return rows.select("block", F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"), *(F.col(f"r.{c}").alias(c) for c in more))

    def alone(t: pa.Table) -> pa.Table:
        ids, x = _flat(t, "ids"), _matrix(t)
        return pa.table(dict(zip(("u", "v", "distance"), near_pairs(ids, x, ids, x, k))))

    def cell(t: pa.Table) -> pa.Table:
        a, b = ((_flat(s, "ids"), _matrix(s), _flat(s, "bound")) for s in (t.filter(pc.equal(t["side"], side)) for side in (0, 1)))
        found = near_both(a, a if t["inside"][0].as_py() else b, k)
        return pa.table(dict(zip(("u", "v", "distance"), found)))

    pairs = packed(vectors, F.pmod(hashed, F.lit(parts)), -(-n // parts)).repartitionById(parts, "block").groupBy("block").applyInArrow(alone, schema)
    if max(parts, blocks) > 1:
        bounds = pairs.groupBy(F.col("u").alias("id")).agg(F.get(F.sort_array(F.collect_list("distance")), k - 1).alias("bound"))
        bounded = vectors.join(bounds, "id", "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        sent = packed(bounded, F.pmod(F.shiftright(hashed, 40), F.lit(blocks)), -(-n // blocks), "bound")
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # Cells are numbered row by row: a row's begins after those of the rows before.
        a, b = F.least("block", "other"), F.greatest("block", "other")
        number = (a * blocks - F.floor(a * (a + 1) / 2) + b).cast("int").alias("cell")
        sent = sent.select("ids", "flat", "bound", (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("inside"), number)
        pairs = sent.repartitionById(blocks * (blocks + 1) // 2, "cell").groupBy("cell").applyInArrow(cell, schema)
    pairs = pairs.withColumn("distance", F.round("distance", 6))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("distance", "v"))).where(F.col("rank") <= k)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _matrix(t: pa.Table) -> np.ndarray:
    """A row of double precision for each of the ids."""
    n = len(_flat(t, "ids"))
    return _flat(t, "flat").astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def near_both(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, distance) both ways between a and b, each (ids, vectors, bounds): all that may be among the k nearest others of
    a row and lies within its bound when distances are rounded to 6 decimals. ``b`` is ``a`` for pairs inside of it.

    As in near_pairs, single precision passes over what is farther for certain and copies of a vector count k + 1 times.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    (a, copies), own = _leaders(a, k), b is a
    sides = [(a, copies), (a, copies) if own else _leaders(b, k)]
    b = sides[1][0]
    if not len(a[0]) or not len(b[0]):
        return none
    kept: list[list] = [[], []]
    for i, j, d in _within(a, b):
        if own:
            i, j, d = (z[a[0][i] != a[0][j]] for z in (i, j, d))
        near = d <= a[2][i] + 2e-6
        kept[0].append(_best(i[near], b[0][j[near]], d[near], k))
        if not own:
            near = d <= b[2][j] + 2e-6
            kept[1].append((j[near], a[0][i[near]], d[near]))
            if sum(len(z[0]) for z in kept[1]) > KEPT:
                kept[1] = [_best(*(np.concatenate(z) for z in zip(*kept[1])), k)]
    out = [none]
    for (of, (others, last)), found in zip(sides, kept):
        if found:
            i, j, d = _best(*(np.concatenate(z) for z in zip(*found)), k)
            out.append((of[0][i], j, d))
            # Further copies have the neighbours of the last that counts.
            start, count = np.searchsorted(i, last), np.bincount(i, minlength=len(of[0]))[last]
            at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            out.append((np.repeat(others, count), j[at], d[at]))
    u, v, d = (np.concatenate(z) for z in zip(*out))
    return u, v, d


def _leaders(side: tuple[np.ndarray, ...], k: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """((ids, vectors, bounds), (ids of further copies, places of the last that counts)): finite rows ascending in id, k + 1 of equal vectors."""
    fit = np.flatnonzero(np.isfinite(side[1]).all(1))
    fit = fit[np.argsort(side[0][fit], kind="stable")]
    ids, x, bound = (z[fit] for z in side)
    if not len(ids):
        return (ids, x, bound), (ids, ids)
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_inverse=True)
    by = np.argsort(same, kind="stable")
    first = np.searchsorted(same[by], same[by])
    more = np.arange(len(by)) - first > k
    keep = np.sort(by[~more])
    return (ids[keep], x[keep], bound[keep]), (ids[by[more]], np.searchsorted(keep, by[first[more] + k]))


def _within(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]):
    """Yields (i, j, distance) of rows of a and b that lie within the bound of either, and of some that don't, by strips of a."""
    (_, x, near), (_, y, far) = a, b
    # By bound, so one number bounds a tile closely.
    rows, columns = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    middle, dims, width = y.mean(0), x.shape[1], -(-len(y) // 8) * 8
    u, w = (x - middle)[rows], (y - middle)[columns]
    uu, ww = (u * u).sum(1) / 2, (w * w).sum(1) / 2
    # Half the squared distance by one product: (-u, u.u / 2, 1) . (w, 1, w.w / 2).
    with np.errstate(over="ignore"):
        p, q = np.ones((len(u), dims + 2), np.float32), np.ones((dims + 2, width), np.float32)
        p[:, :dims], p[:, dims] = -u, uu
        q[:dims], q[dims + 1] = 0, 1e37
        q[:dims, : len(w)], q[dims + 1, : len(w)] = w.T, ww
    size = np.sqrt(2 * uu.max()) + np.sqrt(2 * ww.max())
    slack = (dims + 16) * 2.0**-22 * size * size
    # What single precision cannot hold is looked at as a whole.
    held = size < 1e15
    limit, reach = ((z + 2e-6) ** 2 / 2 + slack if held else np.full(len(z), np.inf) for z in (near[rows], far[columns]))
    for lo in range(0, len(u), ROWS):
        found = []
        for left in range(0, width, TILE):
            right = min(left + TILE, width)
            half = p[lo : lo + ROWS] @ q[:, left:right] if held else np.zeros((len(p[lo : lo + ROWS]), right - left), np.float32)
            top = max(limit[min(lo + ROWS, len(u)) - 1], reach[min(right, len(w)) - 1])
            less = (half <= np.float32(top)).reshape(-1)
            # Eight at a time: few are set.
            word = np.flatnonzero(less.view(np.uint64))
            at = np.flatnonzero(less.reshape(-1, 8)[word])
            at = word[at >> 3] * 8 + (at & 7)
            i, j = lo + at // (right - left), left + at % (right - left)
            i, j, value = i[j < len(w)], j[j < len(w)], half.reshape(-1)[at[j < len(w)]]
            good = (value <= limit[i]) | (value <= reach[j])
            found.append((rows[i[good]], columns[j[good]]))
        i, j = (np.concatenate(z) for z in zip(*found))
        d = np.empty(len(i))
        for c in range(0, len(i), PAIRS):
            step = x[i[c : c + PAIRS]] - y[j[c : c + PAIRS]]
            # Added up in the order of the dimensions.
            d[c : c + PAIRS] = np.sqrt(np.add.accumulate(step * step, axis=1)[:, -1])
        fit = np.isfinite(d)
        yield i[fit], j[fit], d[fit]


def _best(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row, distance and id: what is no farther than a row's k-th, distances within 2e-6 being alike; of one distance the k smallest ids."""
    by = np.lexsort((ids, d, i))
    i, ids, d = i[by], ids[by], d[by]
    if not len(i):
        return i, ids, d
    row = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    size = np.diff(np.append(row, len(i)))
    kth = np.repeat(np.where(size >= k, d[np.minimum(row + k, len(i)) - 1], np.inf), size)
    run = np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1])])
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0))
    good = (d <= kth + 2e-6) & (place < k)
    return i[good], ids[good], d[good]


def near_pairs(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, distance): all that may be among the k nearest others of each row of x when distances are rounded to 6 decimals.

    Products in single precision pass over what is farther for certain; the sum over dimensions of what is left runs in
    order, in double precision. Of equal vectors only the k + 1 smallest ids are looked at.
    """
    fit = np.isfinite(x).all(1)
    ids, x = ids[fit], x[fit]
    order = np.argsort(others, kind="stable")
    order = order[np.isfinite(y[order]).all(1)]
    others, y = others[order], y[order]
    if len(y):
        _, same = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.shape[1] * 8))).reshape(-1), return_inverse=True)
        by = np.argsort(same, kind="stable")
        first = np.searchsorted(same[by], same[by])
        keep = np.sort(by[np.arange(len(by)) - first <= k])
        others, y = others[keep], y[keep]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(x) or not len(y):
        return out[0]
    lanes = max(1, min(LANES, len(y) // (8 * k)))
    groups = -(-len(y) // lanes)
    middle, dims = y.mean(0), y.shape[1]
    # Half the squared distance less a row's own part, by one product: (-x, 1) . (y, y.y / 2).
    p, q = np.ones((len(x), dims + 1), np.float32), np.zeros((lanes * groups, dims + 1), np.float32)
    p[:, :dims], q[: len(y), :dims] = middle - x, y - middle
    q[:, dims] = 1e37
    q[: len(y), dims] = ((y - middle) ** 2).sum(1) / 2
    size = np.sqrt(((x - middle) ** 2).sum(1)) + np.sqrt(((y - middle) ** 2).sum(1).max())
    slack = (dims + 16) * 2.0**-22 * size * size
    for lo in range(0, len(x), ROWS):
        rows = slice(lo, lo + ROWS)
        half = p[rows] @ q.T
        at = np.minimum(np.searchsorted(others, ids[rows]), len(others) - 1)
        own = np.flatnonzero(others[at] == ids[rows])
        half[own, at[own]] = np.inf
        least = half.reshape(len(half), lanes, groups).min(1)
        # The k-th least of groups is no nearer than the k-th least of all; distances within 2e-6 may round alike.
        bound = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float) if groups >= k else np.full(len(half), np.inf)
        bound = bound + 2 * slack[rows] + 4e-6 * (size[rows] + 1)
        bound[~np.isfinite(bound) | (size[rows] > 1e15)] = np.inf
        # What single precision cannot hold is looked at as a whole.
        far = np.isinf(bound)
        i, g = np.nonzero((least <= bound[:, None]) | far[:, None])
        value = half.reshape(len(half), lanes, groups)[i, :, g]
        which, lane = np.nonzero((value <= bound[i, None]) | far[i, None])
        i, j = i[which], lane * groups + g[which]
        other = (j < len(y)) & (ids[lo + i] != others[np.minimum(j, len(y) - 1)])
        i, j = i[other], j[other]
        total = np.zeros(len(i))
        for c in range(dims):
            step = x[lo + i, c] - y[j, c]
            total += step * step
        d = np.sqrt(total)
        by = np.lexsort((j, d, i))
        i, j, d = i[by], j[by], d[by]
        start = np.searchsorted(i, np.arange(len(half)))
        count = np.bincount(i, minlength=len(half))
        kth = np.full(len(half), np.inf)
        some = count >= k
        kth[some] = d[start[some] + k - 1]
        # Of one distance, the k smallest ids are enough.
        run = np.concatenate([[True], (np.diff(i) != 0) | (np.diff(d) != 0)]) if len(i) else np.zeros(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(run, np.arange(len(i)), 0)) if len(i) else np.zeros(0, int)
        good = (d <= kth[i] + 2e-6) & np.isfinite(d) & (place < k)
        out.append((ids[lo + i[good]], others[j[good]], d[good]))
    u, v, d = (np.concatenate(part) for part in zip(*out))
    return u, v, d


def knn(spark: SparkSession, sf_dir: str, k: int = 4) -> NetworkFrame:
    """Embeddings joined to their nearest neighbours; positions are the first two dimensions."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # Written once: a measure reads its network several times, and the search is the dear part.
    pairs = cut(nearest_vectors(v, k).select(F.lit("knn").alias("graph_id"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "knn")
    nodes = e.select(F.lit("knn").alias("graph_id"), F.col("vec_id").alias("node_id"), F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return NetworkFrame(nodes, pairs.withColumn("weight", F.lit(None).cast("double")))


def lattice(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """Customers on a jittered grid of 40 columns with some of its edges."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    gx, gy = F.col("id") % 40, F.floor(F.col("id") / 40)
    jitter = lambda k: 0.1 * ((F.col("id") * k) % 11 - 5)
    nodes = c.select(F.lit("lattice").alias("graph_id"), F.col("id").alias("node_id"), (10.0 * gx + jitter(37)).alias("x"), (10.0 * gy + jitter(41)).alias("y"))
    right = c.where(gx < 39).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = c.select(F.col("id").alias("u"), (F.col("id") + 40).alias("v"))
    kept = (F.col("u") * F.col("v") + F.col("u") * 31 + F.col("v") * 17) % 97 < 62
    e = right.unionByName(down).where(kept).join(c.select(F.col("id").alias("v")), "v", "left_semi")
    return NetworkFrame(nodes, e.select(F.lit("lattice").alias("graph_id"), "u", "v", F.lit(None).cast("double").alias("weight")))


def trade(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """Nations joined by the line items between their customers and suppliers; pairs of at least average weight."""
    t = lambda n: table(spark, sf_dir, n)
    # Counted by (order, supplier nation) and by customer nation before nations meet.
    line = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey")
    line = line.groupBy("l_orderkey", "b").agg(F.count("*").alias("k"))
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("a")), "c_custkey")
    w = line.join(orders, "l_orderkey").where("a <> b").groupBy(F.least("a", "b").cast("long").alias("u"), F.greatest("a", "b").cast("long").alias("v")).agg(F.sum("k").cast("double").alias("weight"))
    mean = w.agg(F.avg("weight").alias("mean"))
    e = w.join(F.broadcast(mean)).where("weight >= mean")  # one row
    e = cut(e.select("u", "v", "weight"), "trade")
    nodes = t("nation").select(F.lit("trade").alias("graph_id"), F.col("n_nationkey").cast("long").alias("node_id"), (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    return NetworkFrame(nodes, e.select(F.lit("trade").alias("graph_id"), "u", "v", "weight"), True)


def supply(spark: SparkSession, sf_dir: str) -> NetworkFrame:
    """Parts (even ids) and their suppliers (odd ids)."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")).distinct()
    nodes = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return NetworkFrame(nodes.select(F.lit("supply").alias("graph_id"), "node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), e.select(F.lit("supply").alias("graph_id"), "u", "v", F.lit(None).cast("double").alias("weight")))
