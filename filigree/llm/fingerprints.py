"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where its masked bits are zero,
with a stricter mask before the normal size and a looser one after it
(normalised chunking), so an edit moves only the boundaries beside it.  The
fingerprint is the set of chunk digests with their lengths; likeness is
containment: the length of the chunks that the other set has too, over all.

Defined cases: a null text is empty and has an empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another one are not (0.0).  The next
document is the next row by (doc_id, text); after the last comes the first, and
a lone row is its own next one.  Texts are whole; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import mix
from .shared import pieces_for

LEAST, NORMAL, MOST = 32, 96, 384
GEAR = (mix(np.arange(1, 257, dtype=np.uint64), 0x6765617268617368) >> np.uint64(32)).astype(np.uint32)
#: High bits hold the last 32 bytes; 9 bits before the normal size, 5 after it.
STRICT, LOOSE = np.uint32(0xFF800000), np.uint32(0xF8000000)
PART_BYTES = 16 << 20
#: Ranges at most, whatever the input: their bounds, first ids and SAMPLED ids each pass through the driver.
#: A range is streamed, so a larger one needs no more memory.
MOST_PARTS, SAMPLED = 1 << 16, 40
NULL_ID = np.iinfo(np.int64).min


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last 32 bytes, by doubling."""
    h, span = GEAR[data], 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks; they depend on the text alone."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(raw, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    out, at = [], 0
    while n - at > LEAST:
        end = min(at + MOST, n)
        i = bisect.bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < min(at + NORMAL, end):
            at = strict[i] + 1
        else:
            i = bisect.bisect_left(loose, at + NORMAL)
            at = loose[i] + 1 if i < len(loose) and loose[i] < end else end
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_set(raw: bytes) -> dict[bytes, int]:
    """Digest -> length of the distinct chunks."""
    out, at = {}, 0
    for end in boundaries(raw):
        piece = raw[at:end]
        out[hashlib.blake2b(piece, digest_size=8).digest()] = end - at
        at = end
    return out


def spelled(chunks: dict[bytes, int]) -> str:
    """A set's one spelling: digests in order, each with its length."""
    return ",".join(f"{d.hex()}:{chunks[d]:x}" for d in sorted(chunks))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """How much of a's length lies in chunks that b has."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> NEIGHBOURS, by one shuffle.

    Rows are dealt to ranges of doc_id; the first row of a range goes to the
    range before it as well, so that a sorted stream meets every next row.
    Range bounds come from a bounded sample and only balance the load; what
    passes through the driver is a few numbers a range, of MOST_PARTS ranges at most.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = min(MOST_PARTS, pieces_for(docs, PART_BYTES))
    ids = src.select("doc_id")
    n = ids.count()
    share = min(1.0, SAMPLED * parts / max(1, n))
    sample = sorted(r[0] for r in ids.sample(share, seed=10).where("doc_id is not null").collect())
    cuts = np.array(sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else [], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            part = np.searchsorted(cuts, np.array(ids.fill_null(NULL_ID), np.int64), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", *batch.schema.names])

    # The least id of each range: one row a range comes to the driver.
    found = ids.mapInArrow(place, "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    heads = {r["part"]: None if r["nulls"] else r["head"] for r in found}
    order = sorted(heads)
    bound = [(p, heads[p], order[i - 1]) for i, p in enumerate(order)]  # the first range follows the last
    bound = docs.sparkSession.createDataFrame(bound, "part int, head long, to int")
    tagged = src.mapInArrow(place, "part int, doc_id long, text string").join(F.broadcast(bound), "part")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = tagged.withColumn("copy", F.explode(copies))
    dealt = both.select(F.when(F.col("copy") == 1, F.col("to")).otherwise(F.col("part")).alias("part"), "copy", "doc_id", "text")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("copy", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, bytes, chunks)
        done = False
        rows: list[tuple] = []
        for batch in batches:
            for copy, doc, text in zip(*(batch.column(c).to_pylist() for c in ("copy", "doc_id", "text"))):
                if done:
                    break
                raw = text.encode()
                now = (doc, text, raw, chunk_set(raw))
                if held is not None:
                    rows.append(_row(held, now))
                held, done = (None, True) if copy else (now, False)
            if rows:
                yield _batch(rows)
                rows = []

    return dealt.mapInArrow(run, NEIGHBOURS)


def _row(held: tuple, following: tuple) -> tuple:
    doc, text, raw, chunks = held
    other = edited(text, following[1])
    other_raw = other.encode()
    other_chunks = chunk_set(other_raw)
    return (doc, len(text), hashlib.sha256(other_raw).hexdigest(), spelled(chunks), spelled(other_chunks), containment(chunks, other_chunks), containment(chunks, following[3]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in NEIGHBOURS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
