"""Embedding near-dedup over a robust-pruned flat graph.

Steps.  Equal vectors of a label become one class.  *Balls*: rows within half of
the link angle of a pivot all link with each other, so a dense group is one node
of the graph, whatever its size; pivots come from bounded samples of cells that
are split until a cell is its own sample.  *Shards*: nodes are dealt to their
``OVERLAP`` nearest cluster centres, again and again until a shard fits a task.
*Graph*: each shard gives its nodes' robust-pruned neighbours (near ones and
random far ones, and the reverse edges); adjacency lists of a node from all its
shards are united.  *Search*: every node is a query in its shards.  From the shard's
medoids a greedy search follows the united lists with a beam; then all that lies in
range is expanded until nothing in range is new.  *Verify*: two single vectors
link by their cosine in double precision; a ball and a node link as a whole where the
triangle inequality of angles says so, and are compared member by member, in
cells of bounded size, where it does not.  *Audit*: a bounded sample of classes is
compared with all rows; if less than TARGET of its links was found, beam and
overlap grow and the search runs again; below LEAST after the last turn it fails.

So no link is reported below the limit, and links inside and between balls are
whole; a link of two nodes can be missed only if no shard holds both or a
search ends early.  What the audit found is in ``audit_recall``.

Defined cases: rows without id or label, and vectors that are null, empty, zero or
hold null or non-finite components link with nothing; vectors of different
length don't link; equal vectors of one label link; of rows with one id and
different vectors the one that sorts first links for the id; repeated rows are
one vector and are returned as often as they occur; a row without an id has a
null component; an empty table gives no rows; other columns are not read.
A task holds at most SAMPLE, SHARD or 2 * CELL vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, cos, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .sketches import components

COSINE = 0.93
#: Vectors of a fit (a cell up to this size is its own sample), of a shard, of a salted part of a larger one, of a block of a cell.
SAMPLE, SHARD, PART, CELL = 4096, 4000, 8192, 1024
#: Rows of a sample that make a ball; centres of a split at most; splits at most.
DENSE, CENTRES, SPLITS = 8, 64, 12
#: Classes that the audit compares with all rows.
AUDIT, TARGET, LEAST, TURNS = 1024, 0.99, 0.9, 3
#: Angles are known to about this.
SLACK = 1e-6

ROWS = "cell string, id long, w long, u binary"
MEMBERS = "cell string, ball string, id long, w long, u binary, angle double"
PLACED = "shard string, id long, u binary, r double"


@dataclass(frozen=True)
class Search:
    overlap: int = 3
    degree: int = 24
    pool: int = 48
    alpha: float = 1.2
    beam: int = 32
    expand: int = 4
    medoids: int = 16

    def wider(self) -> Search:
        return Search(self.overlap + 2, 2 * self.degree, 2 * self.pool, self.alpha, 3 * self.beam, self.expand, 2 * self.medoids)


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _raw(u: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(u, "<f8")]


def _angle(c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(c, -1.0, 1.0))


def _rng(name: str) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(name.encode()))


# --- classes


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): one vector an id, that can link."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    found = rows.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*")


def unit_rows(classes: DataFrame) -> DataFrame:
    """ROWS of classes(label, v, id, w); the first cell is the label and the length."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for x in batch.column(3):
                v = x.values.to_numpy()
                v = v / np.abs(v).max()
                raw.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["cell", "id", "w", "u"])

    cell = F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("cell")
    return classes.select(cell, "id", "w", "v").mapInArrow(units, ROWS)


# --- balls


def pivots_of(u: np.ndarray, radius: float, dense: int = DENSE) -> np.ndarray:
    """Mean directions of dense groups, the densest first; each of at least ``dense`` rows within the radius."""
    near = np.concatenate([u[a : a + 512] @ u.T >= cos(radius) for a in range(0, len(u), 512)])
    count = near.sum(axis=1)
    left = np.ones(len(u), bool)
    out = []
    while len(u):
        k = int(np.argmax(np.where(left, count, 0)))
        if not left[k] or count[k] < dense:
            break
        mean = u[near[k] & left].sum(axis=0)
        pivot = mean / np.linalg.norm(mean)
        gone = left & ((u @ pivot >= cos(radius)) | (np.arange(len(u)) == k))
        out.append(pivot)
        left &= ~gone
        count = count - near[:, gone].sum(axis=1)
    return np.array(out).reshape(-1, u.shape[1] if len(u) else 0)


def centres_of(u: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    """Spherical k-means."""
    centre = u[rng.choice(len(u), min(k, len(u)), replace=False)]
    for _ in range(turns):
        own = np.argmax(u @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, u)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centre)
    return centre


def _in_balls(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pivot or -1, angle to it)."""
    if not len(pivots):
        return np.full(len(u), -1), np.zeros(len(u))
    likeness = u @ pivots.T
    which = np.argmax(likeness, axis=1)
    angle = _angle(likeness[np.arange(len(u)), which])
    inside = angle <= radius
    return np.where(inside, which, -1), np.where(inside, angle, 0.0)


def _member_table(cell: list, ball: list, table: pa.Table, angle: np.ndarray) -> pa.Table:
    return pa.table({"cell": pa.array(cell, pa.string()), "ball": pa.array(ball, pa.string()), "id": table.column("id"), "w": table.column("w"), "u": table.column("u"), "angle": pa.array(angle, pa.float64())})


def _pivot_table(cell: str, pivots: np.ndarray) -> pa.Table:
    """Rows without an id that carry the balls' pivots."""
    k = len(pivots)
    return pa.table({"cell": pa.array([cell] * k, pa.string()), "ball": pa.array([f"{cell}#{i}" for i in range(k)], pa.string()), "id": pa.nulls(k, pa.int64()), "w": pa.nulls(k, pa.int64()), "u": pa.array(_raw(pivots), pa.binary()), "angle": pa.nulls(k, pa.float64())})


def _each(table: pa.Table, name: str) -> Iterator[tuple[str, pa.Table]]:
    """A group's tables by ``name``, rows by id."""
    table = table.combine_chunks().sort_by([(name, "ascending"), ("id", "ascending")])
    names = np.asarray(table.column(name).to_numpy(), object)
    cuts = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield names[a], table.slice(a, b - a)


def _packed(rows: DataFrame, sizes: DataFrame, name: str, most: int) -> DataFrame:
    """rows with ``pack``: small groups of ``name`` share one."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    small = F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(max(1, 2 * total // most))).cast("string"))
    return rows.join(sizes, name).withColumn("pack", F.when(F.col("n") > most // 4, F.col(name)).otherwise(small)).drop("n")


def _u01(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _fitted(rows: DataFrame, name: str, turn: int, radius: float, fit) -> DataFrame:
    """(name, salt, pivots, centres), a row a salted part, fitted on samples of at most about SAMPLE rows of rows(name, id, u, n)."""

    def run(table: pa.Table) -> pa.Table:
        for key, part in _each(table, name):
            pivots, centres = fit(key, _matrix(part.column("u")), part.column("n")[0].as_py())
            return pa.table({name: [key], "n": [part.column("n")[0].as_py()], "dims": pa.array([centres.shape[1]], pa.int32()), "pivots": pa.array([pivots.astype("<f8").tobytes()], pa.binary()), "centres": pa.array([centres.astype("<f8").tobytes()], pa.binary())})

    sample = rows.where(_u01("id", F.lit(turn)) * F.col("n") < SAMPLE).select(name, "id", "u", "n")
    return written(sample.groupBy(name).applyInArrow(run, f"{name} string, n long, dims int, pivots binary, centres binary"), "fits")


def _salted(rows: DataFrame, fits: DataFrame, name: str, run, schema: str) -> DataFrame:
    """run(table, pivots, centres, key) over parts of at most about PART rows."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")).drop("n")
    right = fits.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))

    def both(table: pa.Table, fit: pa.Table) -> pa.Table:
        if not table.num_rows or not fit.num_rows:
            return run(table.slice(0, 0), np.zeros((0, 0)), np.zeros((0, 0)), "")
        pivots, centres = (np.frombuffer(fit.column(c)[0].as_py(), "<f8").reshape(-1, fit.column("dims")[0].as_py()) for c in ("pivots", "centres"))
        return run(table, pivots, centres, fit.column(name)[0].as_py())

    return left.groupBy(name, "salt").cogroup(right.groupBy(name, "salt")).applyInArrow(both, schema)


def ball_members(rows: DataFrame, radius: float) -> DataFrame:
    """MEMBERS of ROWS: every row once, in a ball or alone, and each ball's pivot in a row without an id."""

    def whole(table: pa.Table) -> pa.Table:
        out = []
        for cell, part in _each(table, "cell"):
            u = _matrix(part.column("u"))
            pivots = pivots_of(u, radius)
            ball, angle = _in_balls(u, pivots, radius)
            out += [_member_table([cell] * len(u), [f"{cell}#{b}" if b >= 0 else None for b in ball], part, angle), _pivot_table(cell, pivots)]
        return pa.concat_tables(out)

    def fit(key: str, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return pivots_of(u, radius), centres_of(u, min(CENTRES, -(-2 * n // SAMPLE)), _rng(key))

    def part(table: pa.Table, pivots: np.ndarray, centres: np.ndarray, key: str) -> pa.Table:
        if not table.num_rows:
            return _member_table([], [], table, np.zeros(0))
        u = _matrix(table.column("u"))
        ball, angle = _in_balls(u, pivots, radius)
        near = np.argmax(u @ centres.T, axis=1)
        return _member_table([key if b >= 0 else f"{key}.{c}" for b, c in zip(ball, near)], [f"{key}#{b}" if b >= 0 else None for b in ball], table, angle)

    done = []
    for turn in range(SPLITS):
        sizes = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
        fits_task = F.col("n") <= SAMPLE
        direct = _packed(rows, sizes.where(fits_task), "cell", SAMPLE)
        done.append(written(direct.groupBy("pack").applyInArrow(whole, MEMBERS), "members"))
        if sizes.where(~fits_task).isEmpty():
            return _union(done)
        large = rows.join(sizes.where(~fits_task), "cell")
        fits = _fitted(large, "cell", turn, radius, fit)
        dealt = written(_salted(large, fits, "cell", part, MEMBERS), "dealt")
        done.append(dealt.where("ball is not null"))
        done.append(fits.select("cell", "dims", "pivots").mapInArrow(_pivot_rows, MEMBERS))
        rows = dealt.where("ball is null").select("cell", "id", "w", "u")
    # What so many splits have not parted lies apart, but not densely: each row is a node of its own.
    return _union([*done, rows.select("cell", F.lit(None).cast("string").alias("ball"), "id", "w", "u", F.lit(0.0).alias("angle"))])


def _pivot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell, dims, raw in zip(*(c.to_pylist() for c in batch.columns)):
            yield from _pivot_table(cell, np.frombuffer(raw, "<f8").reshape(-1, dims)).to_batches()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# --- shards


def placed_nodes(nodes: DataFrame, overlap: int) -> DataFrame:
    """PLACED rows of nodes(cell, id, u, r): each node in the shards of its nearest centres.

    What splitting does not bring down to SHARD is dealt into blocks by hash, and
    every two of its blocks make a shard, so that all its nodes still meet.
    """
    rows = nodes.select(F.col("cell").alias("shard"), "id", "u", "r")

    def fit(key: str, u: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((0, u.shape[1])), centres_of(u, max(overlap + 1, min(CENTRES, -(-3 * overlap * n // (2 * SHARD)))), _rng(key))

    def part(table: pa.Table, pivots: np.ndarray, centres: np.ndarray, key: str) -> pa.Table:
        u = _matrix(table.column("u")) if table.num_rows else np.zeros((0, 1))
        near = np.argsort(-(u @ centres.T), axis=1, kind="stable")[:, :overlap] if len(u) else np.zeros((0, 0), int)
        each = pa.array(np.repeat(np.arange(len(u)), near.shape[1]))
        out = table.select(["id", "u", "r"]).take(each)
        return out.add_column(0, "shard", pa.array([f"{key}.{c}" for c in near.ravel()], pa.string()))

    done = []
    for turn in range(SPLITS):
        sizes = written(rows.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
        fits_task = F.col("n") <= SHARD
        done.append(rows.join(sizes.where(fits_task & (F.col("n") > 1)).select("shard"), "shard", "left_semi"))
        if sizes.where(~fits_task).isEmpty():
            return _union(done)
        large = rows.join(sizes.where(~fits_task), "shard")
        rows = written(_salted(large, _fitted(large, "shard", 100 + turn, 0.0, fit), "shard", part, PLACED), "placed")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"))
    dealt = rows.join(sizes, "shard").withColumn("blocks", F.ceil(2 * F.col("n") / SHARD).cast("int") + 1)
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    other = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws("~", "shard", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return _union([*done, other.select(pair.alias("shard"), "id", "u", "r").distinct()])


# --- graph


def pruned(u: np.ndarray, p: int, pool: int, degree: int, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """(rows, degree) robust-pruned neighbours of rows p, p + 1, ... of a block of 256, -1 where there are fewer.

    The pool of a row is its nearest rows and some random ones.  The nearest of
    what is left is taken, and goes with all that it is nearer to, by the factor alpha, than the row is.
    """
    m = len(u)
    block = np.arange(p, min(p + 256, m))
    likeness = u[block] @ u.T
    likeness[np.arange(len(block)), block] = -2.0
    near = np.argpartition(-likeness, min(pool // 2, m - 1) - 1, axis=1)[:, : pool // 2]
    far = rng.integers(0, m, (len(block), pool - near.shape[1]))
    cand = np.concatenate([near, far], axis=1)
    own = 2 - 2 * np.take_along_axis(likeness, cand, axis=1)
    own[cand == block[:, None]] = np.inf
    vec = u[cand]
    apart = 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    out = np.full((len(block), degree), -1)
    rows = np.arange(len(block))
    for k in range(degree):
        best = np.argmin(own, axis=1)
        real = np.isfinite(own[rows, best])
        if not real.any():
            break
        out[real, k] = cand[rows, best][real]
        own[alpha * alpha * apart[rows, best] <= own] = np.inf
        own[rows, best] = np.inf
        own[cand == cand[rows, best][:, None]] = np.inf
    return out


def medoids_of(u: np.ndarray, k: int) -> np.ndarray:
    """The row nearest to the mean, then rows that are farthest from those taken."""
    out = [int(np.argmax(u @ u.mean(axis=0)))]
    best = u @ u[out[0]]
    while len(out) < min(k, len(u)):
        out.append(int(np.argmin(best)))
        best = np.maximum(best, u @ u[out[-1]])
    return np.array(out)


def reached(adjacency: np.ndarray, start: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(adjacency), bool)
    seen[start] = True
    front = start
    while len(front):
        to = np.unique(adjacency[front])
        front = to[(to >= 0) & ~seen[to]]
        seen[front] = True
    return seen


def shard_graph(u: np.ndarray, name: str, s: Search) -> np.ndarray:
    """(rows, most) neighbours, -1 beyond; every row can be reached from the medoids."""
    m, rng = len(u), _rng(name)
    if m <= s.degree + 1:
        return np.array([[j for j in range(m) if j != i] for i in range(m)]).reshape(m, m - 1)
    out = np.concatenate([pruned(u, p, min(s.pool, 2 * m), s.degree, s.alpha, rng) for p in range(0, m, 256)])
    # Reverse edges, the nearest ``degree`` of each row.
    source, slot = np.nonzero(out >= 0)
    target = out[source, slot]
    order = np.lexsort((source, -np.einsum("ij,ij->i", u[source], u[target]), target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((m, s.degree), -1)
    some = rank < s.degree
    back[target[some], rank[some]] = source[some]
    graph = np.concatenate([out, back, np.full((m, 1), -1)], axis=1)
    start = medoids_of(u, s.medoids)
    while not (seen := reached(graph, start)).all():
        lost = np.flatnonzero(~seen)[:256]
        near = np.flatnonzero(seen)[np.argmax(u[lost] @ u[seen].T, axis=1)]
        # One lost row a reached row at a time; the rest is reached with it, or in the next turn.
        near, first = np.unique(near, return_index=True)
        if (graph[near, -1] >= 0).any():
            graph = np.concatenate([graph, np.full((m, 1), -1)], axis=1)
        graph[near, -1] = lost[first]
    return graph


# --- search


def greedy(u: np.ndarray, graph: np.ndarray, q: np.ndarray, low: np.ndarray, start: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of what the queries found at their lower bounds or above.

    All queries go on at once: each expands the best unexpanded rows of its beam,
    and when its beam is done, what lies in range outside it.
    """
    b, m = len(q), len(u)
    seen = np.zeros((b, m), bool)
    done = np.zeros((b, m), bool)
    beam = np.full((b, s.beam), -1)
    worth = np.full((b, s.beam), -np.inf)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of rows that the queries have not seen."""
        fresh = (rows >= 0) & ~seen[which, rows]
        key = np.unique(which[fresh] * m + rows[fresh])
        which, rows = key // m, key % m
        seen[which, rows] = True
        score = np.empty(len(key))
        for at in range(0, len(key), 1 << 15):
            score[at : at + (1 << 15)] = np.einsum("ij,ij->i", q[which[at : at + (1 << 15)]], u[rows[at : at + (1 << 15)]])
        inside = score >= low[which]
        hits.append((which[inside], rows[inside], score[inside]))
        return which, rows, score

    def into_beam(which: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        nonlocal beam, worth
        if not len(which):
            return
        place = np.arange(len(which)) - np.searchsorted(which, which)
        width = int(place.max()) + 1
        new, value = np.full((b, width), -1), np.full((b, width), -np.inf)
        new[which, place], value[which, place] = rows, score
        beam, worth = np.concatenate([beam, new], axis=1), np.concatenate([worth, value], axis=1)
        best = np.argpartition(-worth, s.beam - 1, axis=1)[:, : s.beam]
        beam, worth = np.take_along_axis(beam, best, axis=1), np.take_along_axis(worth, best, axis=1)

    every = np.arange(b)
    into_beam(*visit(np.repeat(every, len(start)), np.tile(start, b)))
    while True:
        open_ = np.where((beam >= 0) & ~done[every[:, None], beam], worth, -np.inf)
        best = np.argsort(-open_, axis=1)[:, : s.expand]
        which, slot = np.nonzero(np.isfinite(np.take_along_axis(open_, best, axis=1)))
        rows = beam[which, best[which, slot]]
        if not len(which):
            found = [np.concatenate(c) for c in zip(*hits)]
            rest = ~done[found[0], found[1]]
            which, rows = found[0][rest], found[1][rest]
            if not len(which):
                return found[0], found[1], found[2]
        done[which, rows] = True
        into_beam(*visit(np.repeat(which, graph.shape[1]), graph[rows].ravel()))


def _graph_lists(table: pa.Table, s: Search) -> pa.Table:
    out = []
    for shard, part in _each(table, "shard"):
        ids = part.column("id").to_numpy()
        graph = shard_graph(_matrix(part.column("u")), shard, s)
        out.append(pa.table({"id": ids, "near": pa.array([ids[row[row >= 0]] for row in graph], pa.list_(pa.int64()))}))
    return pa.concat_tables(out)


def _found_pairs(table: pa.Table, s: Search, limit: float) -> pa.Table:
    """(a, b, c): nodes of a shard that may link, found by search; a < b."""
    out = [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "c": pa.array([], pa.float64())})]
    for _, part in _each(table, "shard"):
        ids, u, r = part.column("id").to_numpy(), _matrix(part.column("u")), part.column("r").to_numpy()
        near = part.column("near").combine_chunks()
        size = np.asarray(near.value_lengths())
        values = near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
        row = np.repeat(np.arange(len(ids)), size)
        inside = ids[at] == values
        row, at = row[inside], at[inside]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        graph = np.full((len(ids), int(place.max(initial=0)) + 1), -1)
        graph[row, place] = at
        start, most = medoids_of(u, s.medoids), r.max()
        for p in range(0, len(ids), 256):
            q = np.arange(p, min(p + 256, len(ids)))
            low = np.cos(np.minimum(pi, limit + r[q] + most + SLACK))
            i, j, c = greedy(u, graph, u[q], low, start, s)
            i = q[i]
            fit = (i != j) & (c >= np.cos(np.minimum(pi, limit + r[i] + r[j] + SLACK)))
            a, b = ids[i[fit]], ids[j[fit]]
            out.append(pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "c": c[fit]}))
    return pa.concat_tables(out)


def candidate_pairs(nodes: DataFrame, s: Search, limit: float) -> DataFrame:
    """(a, b, c) of nodes(cell, id, u, r) that the search found, each pair once."""
    placed = written(placed_nodes(nodes, s.overlap), "shards")
    sizes = written(placed.groupBy("shard").agg(F.count("*").alias("n")), "shard-sizes")
    dealt = written(_packed(placed, sizes, "shard", SHARD), "packs")
    lists = dealt.groupBy("pack").applyInArrow(lambda t: _graph_lists(t, s), "id long, near array<long>")
    united = written(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")
    found = dealt.join(united, "id").groupBy("pack").applyInArrow(lambda t: _found_pairs(t, s, limit), "a long, b long, c double")
    return written(found.groupBy("a", "b").agg(F.max("c").alias("c")), "pairs")


# --- links


def _cell_counts(table: pa.Table, cosine: float) -> pa.Table:
    """Links across a cell: rows (id, k, null, null) of counts and (null, null, a, b) of nodes that link."""
    left, right = table.filter(table.column("left")), table.filter(pc.invert(table.column("left")))
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("id", "k", "a", "b")})
    if not left.num_rows or not right.num_rows:
        return empty
    link = _matrix(left.column("u")) @ _matrix(right.column("u")).T >= cosine
    counts = []
    for side, other, hit in ((left, right, link), (right, left, link.T)):
        k = hit @ other.column("w").to_numpy()
        some = k > 0
        counts.append(pa.table({"id": side.column("id").to_numpy()[some], "k": k[some], "a": pa.nulls(int(some.sum()), pa.int64()), "b": pa.nulls(int(some.sum()), pa.int64())}))
    b = np.unique(right.column("b").to_numpy()[link.any(axis=0)])
    edges = pa.table({"id": pa.nulls(len(b), pa.int64()), "k": pa.nulls(len(b), pa.int64()), "a": np.full(len(b), left.column("a")[0].as_py()), "b": b})
    return pa.concat_tables([empty, *counts, edges])


def cell_links(pairs: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(id, k, a, b) of pairs(a, b) of nodes whose members must be compared one by one; a is the larger."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int")
    size = nodes.select("id", "m")
    right = pairs.join(members.select(F.col("node").alias("b"), "id", "w", "u"), "b")
    shape = right.groupBy("a").agg(parts(F.count("*")).alias("nj")).join(size.select(F.col("id").alias("a"), parts(F.col("m")).alias("ni")), "a")
    shape = written(shape, "cells")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    rights = right.join(shape, "a").withColumn("j", own("nj")).withColumn("i", spread("ni")).select("a", "i", "j", F.lit(False).alias("left"), "b", "id", "w", "u")
    lefts = members.withColumnRenamed("node", "a").join(shape, "a").withColumn("i", own("ni")).withColumn("j", spread("nj")).select("a", "i", "j", F.lit(True).alias("left"), F.lit(None).cast("long").alias("b"), "id", "w", "u")
    return lefts.unionByName(rights).groupBy("a", "i", "j").applyInArrow(lambda t: _cell_counts(t, cosine), "id long, k long, a long, b long")


def audit_recall(rows: DataFrame, counts: DataFrame, cosine: float, most: int = AUDIT) -> tuple[float, int]:
    """(share found, number) of the links of up to ``most`` classes chosen by hash, by comparison with all ROWS."""
    some = rows.join(counts, "id").orderBy(F.xxhash64("id", F.lit(13)), "id").limit(most).select("cell", "id", "w", "u", "n_links").collect()
    chosen: dict[str, list] = {}
    for r in some:
        chosen.setdefault(r.cell, []).append(r)
    held = rows.sparkSession.sparkContext.broadcast({c: (np.array([r.id for r in x]), np.array([np.frombuffer(r.u, "<f8") for r in x])) for c, x in chosen.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for cell, part in _each(table, "cell"):
                if cell in held.value:
                    ids, u = held.value[cell]
                    k = part.column("w").to_numpy() @ (_matrix(part.column("u")) @ u.T >= cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k)], ["id", "k"])

    true = {r.id: r.k - 1 for r in rows.select("cell", "id", "w", "u").mapInArrow(count, "id long, k long").groupBy("id").agg(F.sum("k").alias("k")).collect()}
    every = sum(true.values())
    return (sum(min(r.n_links, true[r.id]) for r in some) / every if every else 1.0), every


def link_counts(members: DataFrame, nodes: DataFrame, s: Search, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) of every class, and the links (a, b) of nodes."""
    limit = acos(cosine)
    pairs = candidate_pairs(nodes.select("cell", "id", "u", "r"), s, limit)
    end = lambda n, x: nodes.select(F.col("id").alias(n), F.col("r").alias(f"r{x}"), F.col("total").alias(f"w{x}"), F.col("m").alias(f"m{x}"))
    seen = pairs.join(end("a", "a"), "a").join(end("b", "b"), "b")
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    sure = F.when(single, F.col("c") >= cosine).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c")))) + F.col("ra") + F.col("rb") <= limit - SLACK)
    judged = written(seen.withColumn("sure", sure).withColumn("open", ~single & ~F.col("sure")), "judged")
    whole = judged.where("sure")
    swap = F.struct(F.col("ma").alias("m"), F.negative("a")) >= F.struct(F.col("mb").alias("m"), F.negative("b"))
    unsure = judged.where("open").select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b"))
    own = members.select("node", "id", "w", "u")
    cells = written(cell_links(unsure, own, nodes, cosine), "cell-links")
    beside = whole.select(F.col("a").alias("node"), F.col("wb").alias("k")).unionByName(whole.select(F.col("b").alias("node"), F.col("wa").alias("k"))).groupBy("node").agg(F.sum("k").alias("beside"))
    single_counts = cells.where("id is not null").groupBy("id").agg(F.sum("k").alias("by_one"))
    zero = F.lit(0).cast("long")
    counts = members.join(nodes.select(F.col("id").alias("node"), "total"), "node").join(beside, "node", "left").join(single_counts, "id", "left")
    counts = counts.select("id", "node", (F.col("total") - 1 + F.coalesce("beside", zero) + F.coalesce("by_one", zero)).alias("n_links"))
    links = whole.select("a", "b").unionByName(cells.where("id is null").select("a", "b")).distinct()
    return written(counts, "link-counts"), written(links, "links")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, s: Search = Search(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """rows -> (vec_id, n_links, component_id, kept, audit_recall), a row each."""
    given = written(usable(rows, key, vector, label), "vectors")
    classes = written(given.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "classes")
    base = written(unit_rows(classes), "units")
    # Rows within half of the link angle of a pivot link with each other.
    found = written(ball_members(base, acos(cosine) / 2 - SLACK), "balls")
    inside = found.where("id is not null and ball is not null")
    ball = inside.groupBy("ball").agg(F.min("id").alias("node"), F.sum("w").alias("total"), F.max("angle").alias("r"), F.count("*").alias("m"))
    ball = written(ball, "ball-nodes")
    alone = found.where("id is not null and ball is null")
    top = F.substring_index("cell", ".", 1).alias("cell")
    centre = found.where("id is null").select("ball", top, "u").join(ball, "ball").select("cell", F.col("node").alias("id"), "u", "r", "total", "m")
    nodes = written(centre.unionByName(alone.select(top, "id", "u", F.lit(0.0).alias("r"), F.col("w").alias("total"), F.lit(1).cast("long").alias("m"))), "nodes")
    members = inside.join(ball.select("ball", "node"), "ball").select("node", "id", "w", "u").unionByName(alone.select(F.col("id").alias("node"), "id", "w", "u"))
    members = written(members, "members")
    for turn in range(TURNS):
        counts, links = link_counts(members, nodes, s, cosine)
        recall, _ = audit_recall(base, counts, cosine)
        if recall >= TARGET:
            break
        s = s.wider()
    if recall < LEAST:
        raise RuntimeError(f"the audit found {recall:.3f} of the links after {TURNS} searches")
    label_of = components(links)
    of = counts.join(label_of.withColumnRenamed("id", "node"), "node", "left").select("id", "n_links", F.coalesce("component", "node").alias("component"))
    of = classes.join(of, "id").select("label", "v", "n_links", "component")
    each = given.join(of, ["label", "v"]).select("vec_id", "n_links", "component")
    out = rows.select(F.col(f"`{key}`").alias("vec_id")).join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(recall).alias("audit_recall"))
