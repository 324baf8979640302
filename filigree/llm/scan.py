"""Vectorised scanning of whole text columns: words, rolling hashes, windows.

Everything here works on the UTF-8 buffer of an Arrow string column.  Word
separators are ASCII, so byte positions are safe to split at.  Hashes are
polynomials modulo 2**64 taken from prefix sums; multipliers are odd, hence
invertible, and every value is finalised with a bijective mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Bytes that begin a code point.
IS_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASES = (0xD1B54A32D192ED03 | 1, 0x8CB92BA72F3D8DD7 | 1)
_SALTS = (0x2545F4914F6CDD1D, 0xA0761D6478BD642F)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U64) ^ U64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = n + n // 8 + 1  # workers keep these tables
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_byte_powers = _Powers(_BYTE_BASE)
_word_powers = tuple(_Powers(b) for b in _WORD_BASES)


def prefix_hash(values: np.ndarray, powers: _Powers) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j over j < i, modulo 2**64."""
    up, _ = powers.get(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.multiply(values, up[: len(values)], out=out[1:], dtype=U64, casting="unsafe")
    np.cumsum(out[1:], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash of values[start:end], the same wherever the run stands."""
    _, down = powers.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def rolling_hash(prefix: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """range_hash of every whole run of ``width``, without gathering."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U64)
    out = prefix[width:] - prefix[:n]
    out *= powers.get(len(prefix))[1][:n]
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system, so that a kept worker holds only what it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a row is never split. Scratch memory goes back after the last."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
    give_back()


class Words:
    """Words of consecutive texts: ``start``/``end`` bytes, ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER_ASCII[data] if lower else data
        self.offsets = offsets
        solid = ~IS_SPACE[self.data]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        starts[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.solid = solid
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        prefix = prefix_hash(self.data, _byte_powers)
        h = range_hash(prefix, self.start, self.end, _byte_powers)
        return mix(h + (self.end - self.start).astype(U64) * U64(_BYTE_BASE))

    def text_of(self) -> np.ndarray:
        """Number of the text that holds each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of values[i:i+k] for every i with a whole window."""
    if len(values) < k:
        return np.zeros(0, U64)
    powers = _word_powers[which]
    prefix = prefix_hash(mix(values, _SALTS[which]), powers)
    return mix(rolling_hash(prefix, k, powers), _SALTS[which] ^ k)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the values at which a window of k lies in one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """min(values[i:i+w]) for every whole window, in log2(w) passes."""
    if len(values) < w:
        return values[:0]
    out, span = values, 1
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        rest = w - span
        out = np.minimum(out[: len(values) - w + 1], out[rest : rest + len(values) - w + 1])
    return out


_PLACE = U64((1 << 24) - 1)


def least_at(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the (leftmost) least of values[i:i+w] for every whole window, by the values' high bits."""
    i = np.arange(len(values), dtype=U64)
    packed = values & ~_PLACE
    packed |= i & _PLACE
    least = sliding_min(packed, w)
    i = i[: len(least)]
    out = least - i
    out &= _PLACE
    out += i
    return out.view(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i, empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans_of(cover_start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean cover of n places by runs of ``length`` from each start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, cover_start, 1)
    np.add.at(edge, np.minimum(cover_start + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
