"""A distributed count of which 64-bit values occur more than once.

Documents are dealt into groups by hash.  A group sends each of its distinct
values once, as packed residues per bucket; a bucket answers with one bit a
value: does another group have it too?  So a value that a third of all rows
share costs one residue a group, and traffic is a few bytes a value.  A residue
is 32 bits beside the bucket's own; a chance collision only lets a value pass
that a later exact step judges, never the reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
SENT = "grp long, bkt int, vals binary"


def with_group(docs: DataFrame, groups: int, key: str = "doc_id") -> DataFrame:
    return docs.withColumn("grp", F.pmod(F.xxhash64(key), F.lit(groups)))


class Ballot:
    """A group's distinct values, by bucket: what to send, and how to read the answer."""

    def __init__(self, values: np.ndarray, buckets: int):
        self.distinct, self.inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.local = counts > 1
        bucket = (self.distinct >> U64(32)) % U64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1).astype(U64))

    def rows(self, grp: int) -> Iterator[tuple[int, int, bytes]]:
        low = (self.distinct & U64(0xFFFFFFFF)).astype("<u4")[self.order]
        for b in np.flatnonzero(np.diff(self.cuts)):
            yield grp, int(b), low[self.cuts[b] : self.cuts[b + 1]].tobytes()

    def repeated(self, masks: dict[int, bytes]) -> np.ndarray:
        """For each of the values given: does it occur anywhere else, here or in another group?"""
        found = np.zeros(len(self.distinct), bool)
        for b, mask in masks.items():
            lo, hi = self.cuts[b], self.cuts[b + 1]
            found[self.order[lo:hi]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
        return (found | self.local)[self.inverse]


def sent_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    grp, bkt, vals = zip(*rows) if rows else ((), (), ())
    return pa.table({"grp": pa.array(grp, pa.int64()), "bkt": pa.array(bkt, pa.int32()), "vals": pa.array(vals, pa.binary())})


def _count(table: pa.Table) -> pa.Table:
    vals = [np.frombuffer(x, "<u4") for x in table.column("vals").to_pylist()]
    cuts = np.cumsum([0, *map(len, vals)])
    _, inverse, counts = np.unique(np.concatenate(vals), return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    masks = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"grp": table.column("grp"), "bkt": table.column("bkt"), "mask": pa.array(masks, pa.binary())})


def answers(sent: DataFrame) -> DataFrame:
    """(grp, bkt, mask) of the ballots in ``sent``."""
    return sent.groupBy("bkt").applyInArrow(_count, "grp long, bkt int, mask binary")


def read_masks(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bkt").to_pylist(), table.column("mask").to_pylist()))

