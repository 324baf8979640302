"""Lexical retrieval packing with a sharded BM25 inverted index.

Documents are put in order by tokens drawn through idf-weighted min-hashing, so
that alike ones lie together, and ranges of that order are shards; document
frequencies and the mean length are the corpus's.  A shard's tokens make one inverted
index (postings of all distinct tokens of its documents).  The first unused
document is a seed; its BM25 neighbours among the unused ones follow in order
of score and greedily fill the seed's window, no two copies of one text in a
window while others are left; the document that overruns it is cut, and its
rest seeds the next window.  Only a shard's last window can be
short: its pieces are laid into sequences of power-of-two lengths, which need
no padding.

Defined cases: a null or empty text is the end token alone; texts are whole;
repeated rows are packed as often as they occur; ties in score go to the
earlier document of the shard; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import U64, give_back, mix, slices, text_buffer
from .shared import written
from .tokens import default_path, tokenizer

WINDOW, END_ID = 4096, 2
#: BM25's two constants.
K1, B = 1.2, 0.75
#: Bytes of a shard's 16-bit ids.
SHARD_BYTES = 3 << 20
#: Tokens drawn for a document's place in the order; rows handled at once.
KEYS, CUT_DOCS = 6, 128
#: Ranges of the order at most, and documents sampled for each; a range is cut into shards.
MOST_RANGES, SAMPLED = 1 << 16, 15
#: Steps of a weight; cells of the dense table a posting at most; bytes of text tokenised at once.
GRAIN, DENSE, SLICE_BYTES = 1 << 24, 8, 8 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """BM25 over one shard: every distinct token of each document, with postings.

    Weights are whole numbers of 1 / GRAIN, so a score does not hang on the order of its sum.
    Tokens of many documents also stand in a dense table, at most DENSE cells a posting.
    """

    def __init__(self, ids: np.ndarray, cuts: np.ndarray, corpus: tuple[int, float, np.ndarray] | None = None):
        """``corpus``: number of documents, their mean length, and each token's document frequency; those of ids without it."""
        n = len(cuts) - 1
        doc = np.repeat(np.arange(n), np.diff(cuts))
        body = ids != END_ID
        key, tf = np.unique(doc[body] << 16 | ids[body].astype(np.int64), return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        df = np.bincount(term, minlength=1 << 16)
        size = np.diff(cuts)
        n_docs, mean, every = corpus or (n, size.mean(), df)
        norm = K1 * (1 - B + B * size / max(1.0, mean))
        weight = np.ceil(GRAIN * idf_of(n_docs, every)[term] * tf * (K1 + 1) / (tf + norm[doc]))
        # A term of one document of the shard finds no neighbour in it.
        keep = df[term] > 1
        self.doc, self.term, weight = doc[keep], term[keep], weight[keep]
        self.cuts = np.searchsorted(self.doc, np.arange(n + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = self.doc[by_term], weight[by_term]
        self.post_cuts = np.searchsorted(self.term[by_term], np.arange((1 << 16) + 1))
        self.post_size = np.diff(self.post_cuts)
        heavy = np.flatnonzero((self.post_size > 1) & (self.post_size * DENSE >= n))
        self.row = np.full(1 << 16, -1)
        self.row[heavy] = np.arange(len(heavy))
        self.table = np.zeros((len(heavy), n))
        row = self.row[self.term]
        self.table[row[row >= 0], self.doc[row >= 0]] = weight[row >= 0]
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray | None = None) -> np.ndarray:
        """Other unused documents that share a term with the seed, best first."""
        terms = self.term[self.cuts[seed] : self.cuts[seed + 1]]
        row = self.row[terms]
        pick = np.zeros(len(self.table))
        pick[row[row >= 0]] = 1
        score = pick @ self.table
        light = terms[row < 0]
        if len(light):
            size = self.post_size[light]
            at = np.repeat(self.post_cuts[light] - (np.cumsum(size) - size), size)
            at += np.arange(len(at))
            score += np.bincount(self.post_doc[at], self.post_weight[at], minlength=self.n)
        score[seed] = 0
        if used is not None:
            score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def windows_of(index: Index, size: np.ndarray, alike: np.ndarray | None = None, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); all are full but perhaps the last.

    Documents with one number in ``alike`` are copies: retrieval never brings a second one into a
    window, and seeds run through the first ones of all texts, then the second ones.
    """
    n = len(size)
    alike = np.arange(n) if alike is None else alike
    by_text = np.argsort(alike, kind="stable")
    lead = np.flatnonzero(np.diff(alike[by_text], prepend=-1))
    turn = np.empty(n, np.int64)
    turn[by_text] = np.arange(n) - np.repeat(lead, np.diff(np.append(lead, n)))
    seeds = np.argsort(turn, kind="stable").tolist()
    used = np.zeros(n, bool)
    out: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    inside: set[int] = set()
    room, next_free = window, 0
    queue: list[int] = []
    while True:
        while queue and (used[queue[-1]] or alike[queue[-1]] in inside):
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while next_free < n and used[seeds[next_free]]:
                next_free += 1
            if next_free == n:
                break
            doc = seeds[next_free]
            used[doc] = True
            queue = index.neighbours(doc, used)[::-1].tolist()
        used[doc] = True
        inside.add(int(alike[doc]))
        at = 0
        while at < size[doc]:
            take = min(room, int(size[doc]) - at)
            now.append((doc, at, take))
            at, room = at + take, room - take
            if not room:
                out.append(now)
                now, room = [], window
                # What overran the window seeds the next one.
                inside = {int(alike[doc])} if at < size[doc] else set()
                queue = index.neighbours(doc, used)[::-1].tolist() if size[doc] > at >= size[doc] - window else []
    if now:
        out.append(now)
    return out


def power_pieces(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short window as sequences of power-of-two lengths, largest first."""
    total = sum(n for _, _, n in window)
    out, pending = [], list(window[::-1])
    for bit in reversed(range(total.bit_length())):
        want, now = total & (1 << bit), []
        while want:
            doc, at, n = pending.pop()
            take = min(n, want)
            now.append((doc, at, take))
            want -= take
            if take < n:
                pending.append((doc, at + take, n - take))
        if now:
            out.append(now)
    return out


def distinct_tokens(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of each document's distinct tokens without the end token, ascending."""
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    body = ids != END_ID
    key = np.unique(doc[body] << 16 | ids[body].astype(np.int64))
    return key >> 16, key & 0xFFFF


def draws_of(idf: np.ndarray) -> np.ndarray:
    """(KEYS, tokens): exponential draws, sooner for heavier tokens."""
    every = np.stack([mix(np.arange(len(idf), dtype=U64), 0xB25 + k) >> U64(11) for k in range(KEYS)]).astype(np.float64) + 0.5
    return -np.log(every / float(1 << 53)) / np.maximum(idf, 1e-9)


def likeness_keys(ids: np.ndarray, cuts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(documents, KEYS): tokens drawn by idf-weighted min-hashing; two documents draw the same one
    as often as the weights of their tokens agree.  A document without tokens has -1."""
    doc, token = distinct_tokens(ids, cuts)
    out = np.full((len(cuts) - 1, KEYS), -1, np.int64)
    if len(doc):
        lead = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(KEYS):
            draw = draws[k, token]
            least = np.repeat(np.minimum.reduceat(draw, lead), np.diff(np.append(lead, len(doc))))
            at = np.flatnonzero(draw == least)[::-1]
            out[doc[at], k] = token[at]
    return out


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cuts) of encoded documents."""
    return np.frombuffer(b"".join(raw), "<u2"), np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int64)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of CUT_DOCS rows, so that arrays over their tokens stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, CUT_DOCS):
            yield batch.slice(at, CUT_DOCS)


ENCODED = "doc_id long, ids binary, tally binary"


def encoded_table(docs: DataFrame, path: str) -> DataFrame:
    """ENCODED rows of docs(doc_id, text): each document's ids with the end token as 16-bit numbers;
    and a row a task with the counts of its documents, tokens and documents of each token."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally = tokenizer(path), np.zeros((1 << 16) + 2, np.int64)
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            for lo, hi in slices(text_buffer(batch.column(1))[1], SLICE_BYTES):
                n = hi - lo
                ids, cuts = words.texts(batch.column(1).slice(lo, n))
                ids, cuts = np.insert(ids, cuts[1:], END_ID), cuts + np.arange(n + 1)
                for at in range(0, n, CUT_DOCS):
                    part = cuts[at : at + CUT_DOCS + 1]
                    tally[:-2] += np.bincount(distinct_tokens(ids[part[0] : part[-1]], part - part[0])[1], minlength=1 << 16)
                tally[-2:] += n, len(ids)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * cuts).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), packed, pa.nulls(n, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.tobytes()])], names)

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def document_frequencies(encoded: DataFrame) -> tuple[int, int, np.ndarray]:
    """(documents, tokens, documents of each token) from the tallies; at most 65538 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((1 << 16) + 2, np.int64)
        for batch in batches:
            for x in batch.column(0):
                tally += np.frombuffer(x.as_buffer(), np.int64)
        have = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(tally[have])], ["token", "n"])

    rows = encoded.where("tally is not null").select("tally").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    tally = np.zeros((1 << 16) + 2, np.int64)
    tally[rows.token.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return int(tally[-2]), int(tally[-1]), tally[:-2]


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> PIECES, one row a piece."""
    written_ids = written(encoded_table(docs, path or default_path()), "pack-ids")
    encoded = written_ids.where("tally is null").select("doc_id", "ids")
    n_docs, n_tokens, df = document_frequencies(written_ids)
    shards = max(1, 2 * n_tokens // SHARD_BYTES)
    corpus = n_docs, n_tokens / max(1, n_docs), df
    idf = idf_of(n_docs, df)

    def keys_of(batch: pa.RecordBatch, draws: np.ndarray) -> np.ndarray:
        """Keys and a hash of the ids, each big-endian and unsigned, so that they sort as one binary."""
        keys = likeness_keys(*joined(batch.column("ids").to_pylist()), draws)
        salt = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
        return np.ascontiguousarray(np.column_stack([keys + 1, salt]).astype(">u4")).view(f"S{4 * (KEYS + 1)}").ravel()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = draws_of(idf)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch, draws).tolist(), pa.binary())], ["key"])

    # Bounds of the ranges from a sample that hashes choose; they only balance the load.
    ranges = min(shards, MOST_RANGES)
    some = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(max(1, n_docs // (SAMPLED * ranges)))) == 0
    sample = np.sort(np.array([bytes(r[0]) for r in encoded.where(some).mapInArrow(keyed, "key binary").collect()] if ranges > 1 else [], f"S{4 * (KEYS + 1)}"))
    bounds = np.unique(sample[len(sample) * np.arange(1, ranges) // ranges]) if len(sample) else sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = draws_of(idf)
        for batch in small(batches):
            keys = keys_of(batch, draws)
            part = np.searchsorted(bounds, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary()), pa.array(part)], ["doc_id", "ids", "key", "part"])

    def shard_of(table: pa.Table, number: int, first: int) -> tuple[pa.RecordBatch, int]:
        """One shard's pieces, its sequences numbered from ``first``, and the next number."""
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("ids", "ascending")]))
        docs = table.column("doc_id").to_pylist()
        ids, cuts = joined(table.column("ids").to_pylist())
        size = np.diff(cuts)
        alike = np.asarray(table.column("ids").combine_chunks().dictionary_encode().indices)
        filled = windows_of(Index(ids, cuts, corpus), size, alike)
        if filled and sum(n for _, _, n in filled[-1]) < WINDOW:
            filled[-1:] = power_pieces(filled[-1])
        wide = ids.astype("<u4")
        rows = []
        for sequence, window in enumerate(filled, number << 32 | first):
            offset = 0
            for doc, at, n in window:
                begin = cuts[doc] + at
                rows.append((docs[doc], at, n, zlib.crc32(wide[begin : begin + n].tobytes()), int(size[doc]), sequence, offset))
                offset += n
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names), first + len(filled)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, held, size = TaskContext.get().partitionId(), 0, [], 0
        # A range of long documents is cut into several shards.
        for batch in small(batches):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if size > SHARD_BYTES:
                out, first = shard_of(pa.Table.from_batches(held), number, first)
                held, size = [], 0
                yield out
                give_back()
        if held:
            yield shard_of(pa.Table.from_batches(held), number, first)[0]

    dealt = encoded.mapInArrow(placed, "doc_id long, ids binary, key binary, part int").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(fill, PIECES)
