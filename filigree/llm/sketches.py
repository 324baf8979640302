"""MinHash near-dedup with fast similarity sketching.

A sketch has ``COORDS`` coordinates.  In round i < COORDS every shingle is
hashed into one coordinate with value i + h; in round COORDS + j all go to
coordinate j.  A coordinate keeps its least value, so it is decided in the
first round that reaches it, and after at most 2 * COORDS rounds every one is
filled, with the concentration of independent samples.  Banding proposes
candidates; every link is confirmed on the full shingle sets.

Steps: documents with equal sets, by a cryptographic digest of the whole set,
become one class (smallest id).  A census over
the candidates' shingles counts those no other candidate has; a document that
keeps fewer than 85 % of its set beside them can link with nothing, exactly.
What is left of each bucket is compared with a pivot; then with a second one;
and what still lies in different components is compared in full, block by block, so
no link is lost.  Components come from links alone, by repeated hooking and shortcutting.

Defined cases: a null or empty text has no shingles, is its own component and
is kept; with fewer than five words the whole sequence is the one shingle;
repeated rows share one id and one component; of rows with one id and different
texts the one with the smallest digest links for the id; a row without an id
keeps a null component and links with nothing; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import smallest_reachable
from .census import SENT, Ballot, answers, read_masks, sent_table
from .scan import U64, Words, give_back, mix, slices, text_buffer, window_starts, windows
from .shared import bytes_of, written

SHINGLE, COORDS, ROWS = 5, 128, 4
BANDS = COORDS // ROWS
PERCENT = 85
#: Links that one task settles.
LOCAL_LINKS = 50_000
#: Documents a block of a cluster holds.
CELL_DOCS = 600


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): each text's distinct shingles, ascending."""
    hashes = words.hashes()
    counts = words.counts
    at = window_starts(words.first, k)
    text, value = [words.text_of()[at]], [windows(hashes, k)[at] if len(at) else np.zeros(0, U64)]
    for short in range(1, k):
        i = np.flatnonzero(counts == short)
        if len(i):
            text.append(i)
            value.append(windows(hashes, short, 1)[words.first[i]])
    text, value = np.concatenate(text), np.concatenate(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def fast_sketch(values: np.ndarray, cuts: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """(texts, coords) sketches; a text without shingles keeps the largest value everywhere."""
    n = len(cuts) - 1
    size = np.diff(cuts)
    empty = U64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full((n, coords), empty, U64)
    flat = sketch.reshape(-1)
    text = np.repeat(np.arange(n), size)
    active = np.flatnonzero(size > 0)
    for turn in range(2 * coords):
        if not len(active):
            break
        if turn:
            alive = np.zeros(n, bool)
            alive[active] = True
            keep = alive[text]
            values, text = values[keep], text[keep]
        h = mix(values, 0x51ED270B + turn * 0x9E3779B1)
        bin_ = (h % U64(coords)).astype(np.int64) if turn < coords else np.full(len(h), turn - coords)
        value = (U64(turn) << U64(54)) | (mix(h, 1) >> U64(10))
        # Values of later rounds are larger, so what is filled stays.
        np.minimum.at(flat, text * coords + bin_, value)
        active = active[(sketch[active] == empty).any(axis=1)]
    return sketch


def _digests(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(texts, 2): a 128-bit cryptographic digest of each whole set."""
    raw, cut = memoryview(values.astype("<u8").tobytes()), (8 * cuts).tolist()
    every = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:]))
    return np.frombuffer(every, "<i8").reshape(-1, 2)


def _sketched(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                value, cuts = shingles(words)
                size = np.diff(cuts)
                digest = _digests(value, cuts)
                sketch = fast_sketch(value, cuts)
                key = np.zeros((hi - lo, BANDS), U64)
                for r in range(ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) ^ sketch[:, r::ROWS], r)
                key = mix(key + np.arange(BANDS, dtype=U64), 77).view(np.int64)
                filled = size > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)), pa.array(key[filled].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, vals): each text's shingle hashes, ascending, and half of their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                value, cuts = shingles(words)
                vals = [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_digests(value, cuts)[:, 0]), pa.array(vals, pa.binary())], ["doc_id", "d1", "vals"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, vals binary")


def _shared_counts(sets: DataFrame, groups: int, total_bytes: int) -> DataFrame:
    """(doc_id, n_shared): how many shingles of each set some other set has too (or might)."""
    buckets = max(16, total_bytes // (16 << 20))
    dealt = sets.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    def values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vals = [np.frombuffer(x, "<u8") for x in table.column("vals").to_pylist()]
        return np.concatenate([np.zeros(0, U64), *vals]).astype(U64), np.cumsum([0, *map(len, vals)])

    def vote(key: tuple, table: pa.Table) -> pa.Table:
        return sent_table(list(Ballot(values(table)[0], buckets).rows(key[0].as_py())))

    def read(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        every, cuts = values(table)
        total = np.concatenate([[0], np.cumsum(Ballot(every, buckets).repeated(read_masks(masks)))])
        return pa.table({"doc_id": table.column("doc_id"), "n_shared": pa.array(total[cuts[1:]] - total[cuts[:-1]])})

    masks = answers(dealt.groupBy("grp").applyInArrow(vote, SENT))
    return dealt.groupBy("grp").cogroup(masks.groupBy("grp")).applyInArrow(read, "doc_id long, n_shared long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                inter = int((q[at] == p).sum())
                good[i] = 100 * inter >= percent * (len(p) + len(q) - inter)
            yield batch.select(["a", "b"]).filter(pa.array(good))
            give_back()

    left = sets.select(F.col("doc_id").alias("a"), F.col("vals").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("vals").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """links(a, b) -> (id, component): smallest id reachable, for every id in a link.

    Up to LOCAL_LINKS links are settled in one task.  More of them are thinned to
    forests where they lie; then each round joins every id to the smallest label
    beside it and lets labels follow their own label, both aggregations and
    equi-joins.  Labels settle in a logarithmic number of rounds or so; beyond
    ``most_rounds`` it fails.
    """
    pairs = written(links.select("a", "b").where("a <> b"), "links")
    if pairs.count() <= LOCAL_LINKS:
        return written(pairs.groupBy(F.lit(0).alias("all")).applyInArrow(_settled, "id long, component long"), "labels")
    thin = written(pairs.mapInArrow(_forests, "a long, b long").distinct(), "forests")
    both = written(thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("id"), "c"), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        # An id's root may take the smallest label that any of its members sees.
        seen = label.join(near, label.id == near.a).select("id", F.col("c").alias("old"), F.least("c", "m").alias("m"))
        hooked = seen.groupBy("old").agg(F.min("m").alias("h"))
        moved = seen.join(hooked, "old").select("id", "old", F.least("m", "h").alias("c"))
        up = moved.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        step = written(moved.join(up, "c", "left").select("id", "old", F.coalesce(F.least("c", "cc"), "c").alias("c")), "labels")
        if step.where("c <> old").isEmpty():
            return step.select("id", F.col("c").alias("component"))
        label = step.select("id", "c")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def _settled(table: pa.Table) -> pa.Table:
    ids, label = smallest_reachable(table.column("a").to_numpy(), table.column("b").to_numpy())
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(label, pa.int64())})


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every batch of links a star to the smallest id of each of its components."""
    for batch in batches:
        ids, label = smallest_reachable(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        other = ids != label
        yield pa.RecordBatch.from_arrays([pa.array(label[other]), pa.array(ids[other])], ["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id), one row a row of docs."""
    size = bytes_of(docs)
    base = written(_sketched(docs), "sketches")
    cls = ["n_shingles", "d1", "d2"]
    # Written, so that the joins with it are plain shuffles, whose hot classes are split at run time.
    rep = written(base.where("n_shingles > 0 and doc_id is not null").groupBy(*cls).agg(F.min("doc_id").alias("rep")), "classes")
    member = base.select("doc_id", *cls).join(rep, cls, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    lead = base.join(rep.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").where("n_shingles > 0")
    lead = lead.groupBy("doc_id").agg(F.min(F.struct("d1", "n_shingles", "bands")).alias("m")).select("doc_id", "m.*")
    banded = lead.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(banded.join(shared.select("key"), "key"), "buckets")
    wanted = buckets.select("doc_id").distinct()
    found = _sets(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")).dropDuplicates(["doc_id", "d1"])
    sets = written(found.join(lead.select("doc_id", "d1"), ["doc_id", "d1"], "left_semi").select("doc_id", "vals"), "sets")
    groups = max(1, int(size // (3 << 20)))
    able = _shared_counts(sets, groups, size)
    able = able.join(lead.select("doc_id", "n_shingles"), "doc_id").where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    able = written(able.select("doc_id", "n_shingles", (F.col("n_shingles") - F.col("n_shared")).alias("own")), "able")
    live = written(buckets.join(able, "doc_id"), "live")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    links, label = None, None
    for turn in range(2):
        # The pivot is the document with least of its own (first turn), then of those apart from it.
        pool = live if label is None else live.join(label, F.col("doc_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc_id"))
        if label is not None:
            main = pool.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", F.negative("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
            pool = pool.join(main.select("key", "main"), "key")
            pivot = pool.where("component <> main").groupBy("key")
        else:
            pivot = pool.groupBy("key")
        pivot = pivot.agg(F.min(F.struct("own", "doc_id", "n_shingles")).alias("p")).select("key", F.col("p.doc_id").alias("b"), F.col("p.n_shingles").alias("nb"))
        pairs = pool.join(pivot, "key").where("doc_id <> b").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"), F.col("n_shingles").alias("na"), "nb").where(fits).select("a", "b").distinct()
        if links is not None:
            pairs = _apart(pairs, label)
        found = written(_confirmed(pairs, sets, percent), "found")
        links = found if links is None else links.unionByName(found)
        label = components(links)
    # What is still apart inside a bucket is compared in full, in cells of bounded size.
    pool = live.join(label, F.col("doc_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = pool.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("hub")).where("lo <> hi").select("key", "hub")
    apart = written(pool.join(split, "key").select("hub", "doc_id", "n_shingles", "component").distinct(), "apart")
    label = components(links.unionByName(_cell_links(apart, sets, percent)))
    out = member.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _cell_links(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """apart(hub, doc_id, n_shingles, component) -> confirmed links (a, b) between components.

    Documents whose buckets hang together are a cluster.  A cluster is dealt
    into blocks of about CELL_DOCS, and each pair of its blocks is one cell: a
    task counts overlaps through the cell's inverted index and emits links only,
    so no pair is ever a row and no task holds more than two blocks.
    """
    cluster = components(apart.where("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))
    docs = apart.select("doc_id", "component").distinct().join(cluster.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    docs = written(docs, "clusters")
    blocks = docs.groupBy("cluster").agg(F.ceil(F.count("*") / CELL_DOCS).cast("int").alias("blocks"))
    cells = docs.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A cluster of several blocks has a task's work in each cell; small ones share packs of about one block.
    packs = max(1, docs.count() // CELL_DOCS) * 4
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")))
    cells = cells.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "blocks", pack.alias("pack"))
    dealt = cells.join(sets, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        df = table.to_pandas().sort_values(["cluster", "i", "j", "doc_id"])
        a, b = [], []
        for _, part in df.groupby(["cluster", "i", "j"], sort=False):
            x, y = _overlapping([np.frombuffer(v, "<u8") for v in part.vals], part.component.to_numpy(), part.block.to_numpy(), percent)
            ids = part.doc_id.to_numpy()
            a.append(ids[x])
            b.append(ids[y])
        join = lambda v: pa.array(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64))
        return pa.table({"a": join(a), "b": join(b)})

    return written(dealt.groupBy("pack").applyInArrow(run, "a long, b long"), "found")


def _overlapping(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell between different components; of two blocks only links across them."""
    n = np.array([len(s) for s in sets])
    text = np.repeat(np.arange(len(sets)), n)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    value, post = every[order], text[order]
    head = np.ones(len(value), bool)
    head[1:] = value[1:] != value[:-1]
    term = np.empty(len(value), np.int64)
    term[order] = np.cumsum(head) - 1
    start = np.append(np.flatnonzero(head), len(value))
    cuts = np.concatenate([[0], np.cumsum(n)])
    df = np.diff(start)
    across = block.min() != block.max()
    out_x, out_y = [], []
    for x in range(len(sets)):
        terms = term[cuts[x] : cuts[x + 1]]
        some = terms[df[terms] > 1]
        if 100 * len(some) < percent * n[x]:
            continue
        size = df[some]
        at = np.repeat(start[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        inter = np.bincount(post[at], minlength=len(sets))
        link = (100 * inter >= percent * (n[x] + n - inter)) & (component != component[x])
        link[: x + 1] = False
        if across:
            link &= block != block[x]
        y = np.flatnonzero(link)
        out_x.append(np.full(len(y), x))
        out_y.append(y)
    flat = lambda v: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64)
    return flat(out_x), flat(out_y)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    a = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")
