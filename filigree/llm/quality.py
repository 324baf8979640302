"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses too well and noise too badly.  A document passes
when the ratio of the whole text lies within the band of its length class and
no more than ``chunk_share`` of its bytes lie in fixed chunks that leave the band
of their length; every chunk is judged, the last short one included.  The
count rules of the base (too few words, too many repeated 3-word windows) are
judged first.

Defined cases: a null or empty text has no words and fails the base; a text is
always read whole; rows are judged one by one, so ties, repeated rows and other
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import IS_LEAD, U64, Words, mix, segment_sums, slices, text_buffer, window_starts, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """(up to this many bytes, least ratio, most ratio), and the same for chunks.

    A chunk's limits are no narrower than the whole text's of that length, and
    those of the least chunks allow for the frame's own bytes.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = ((512, 1.05, 3.2), (2048, 1.25, 4.0), (8192, 1.45, 4.5), (float("inf"), 1.55, 6.0))
    chunk_bytes: int = 4096
    chunk: tuple[tuple[float, float, float], ...] = ((64, 0.0, 2.0), (128, 0.85, 2.5), (256, 0.95, 3.2), (512, 1.05, 3.7), (2048, 1.25, 4.5), (float("inf"), 1.35, 5.0))
    chunk_share: float = 0.34
    min_words: int = 50
    repeat_percent: int = 50


@dataclass
class _Packer:
    bands: Bands
    compressor: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self):
        self.compressor = zstandard.ZstdCompressor(level=self.bands.level, write_content_size=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compressor.compress(raw)) if raw else 0.0

    @staticmethod
    def within(limits: tuple[tuple[float, float, float], ...], size: int, ratio: float) -> bool:
        _, low, high = next(x for x in limits if size <= x[0])
        return low <= ratio <= high

    def judge(self, raw: bytes) -> tuple[float, int, int, bool]:
        """(ratio, chunks, chunks outside, inside the bands)."""
        b = self.bands
        ratio = self.ratio(raw)
        inside = self.within(b.whole, len(raw), ratio)
        chunks = bad = bad_bytes = 0
        for at in range(0, len(raw), b.chunk_bytes):
            part = raw[at : at + b.chunk_bytes]
            chunks += 1
            if not self.within(b.chunk, len(part), ratio if len(part) == len(raw) else self.ratio(part)):
                bad += 1
                bad_bytes += len(part)
        # By bytes, so that a short last chunk counts as what it is.
        return ratio, chunks, bad, inside and bad_bytes <= b.chunk_share * len(raw)


def repeated_words(words: Words, k: int = 3) -> np.ndarray:
    """Words of each text that lie in a k-word window found twice or more in that text."""
    hashes = words.hashes()
    at = window_starts(words.first, k)
    covered = np.zeros(len(hashes), bool)
    if len(at):
        key = windows(hashes, k)[at] ^ mix(words.text_of()[at].astype(U64), 7)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = at[twice]
        for j in range(k):
            covered[hit + j] = True
    return segment_sums(covered, words.first)


def measure(column: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    """All counts and verdicts of a column of whole texts."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chunks", "n_bad_chunks")}
    out["ratio"], inside = np.zeros(n), np.zeros(n, bool)
    packer = _Packer(bands)
    for lo, hi in slices(offsets):
        part, local = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words = Words(part, local)
        out["n_words"][lo:hi] = words.counts
        out["word_chars"][lo:hi] = segment_sums(words.solid & IS_LEAD[part], local)
        out["n_symbols"][lo:hi] = segment_sums(SYMBOLS[part], local)
        out["n_repeat_words"][lo:hi] = repeated_words(words)
        raw = part.tobytes()
        for i in range(hi - lo):
            text = raw[local[i] : local[i + 1]]
            lines = [x for x in text.split(b"\n") if x.strip()]
            out["n_dup_lines"][lo + i] = len(lines) - len(set(lines))
            out["ratio"][lo + i], out["n_chunks"][lo + i], out["n_bad_chunks"][lo + i], inside[lo + i] = packer.judge(text)
    out["base_failed"] = (out["n_words"] < bands.min_words) | (100 * out["n_repeat_words"] > bands.repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & inside
    return out


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row a document: ``key``, counts, ``base_failed``, ``kept`` and the compression figures."""
    kind = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in _MEASURES.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[x]) for x in names)], ["key", *names])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(judged, f"key {kind}, {_MEASURES}").withColumnRenamed("key", key)


def quality_filter(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    at = docs.columns.index(text)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(at), bands)["kept"]))

    return docs.mapInArrow(passed, docs.schema)
