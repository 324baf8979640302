"""Suffix-array dedup of raw bytes by prefix-free parsing.

Triggers of a rolling hash (the least of the 20-byte hashes in each 50-byte
string, hence one in every string and the same in equal strings) cut a text
into phrases.  A phrase runs from the first string with its trigger to the end
of the last one, so neighbours overlap by 49 bytes and every 50-byte string
lies in exactly one phrase.  The distinct phrases are the dictionary, a text's
sequence of them its parse.  Dictionary blocks hold all phrases of a trigger;
the suffix array of a block (suffixes of 50 bytes and more) puts equal strings
of different phrases next to each other, and with the phrases' places in the
parse (their first document) this is the corpus order in which a string is a
duplicate if a smaller document stands in its class.

A 50-byte string never reaches over its phrase, so classes of equal strings are
decided by the dictionary's suffixes alone, and of the parse only the phrases'
first documents count; ranks of the parse would order what is equal already.

Two things keep blocks bounded.  A census first finds the triggers that occur
in another place at all; phrases of other triggers are never sent.  Triggers
with very many phrases (edges of a passage that a third of all documents share)
have their phrases cut down to single strings, which are dealt by hash to the
same dictionary blocks and sorted in the same suffix arrays, so that no block
grows with one passage.

Defined cases: a null text is empty; texts are whole; only documents with a
smaller id count, so rows with one id never remove from each other; texts of
fewer than 50 bytes keep all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .census import with_group
from .scan import U64, _Powers, least_at, mix, prefix_hash, range_hash, rolling_hash, text_buffer, window_starts
from .shared import pieces_for

L, GRAM = 50, 20
GROUP_BYTES = 3 << 19
#: Phrases of one trigger in one group, and groups with a trigger, above which its phrases are cut into strings.
HOT, HOT_GROUPS = 256, 4096
NULL_ID = np.iinfo(np.int64).min
_powers = tuple(_Powers(b | 1) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Group:
    """A group's texts in order of id, their 50-byte strings, triggers and phrases."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.table = table.take(order).combine_chunks()
        self.ids = np.array(self.table.column("doc_id").fill_null(NULL_ID), np.int64)
        self.data, self.offsets = text_buffer(self.table.column("text"))
        self.at = window_starts(self.offsets, L)
        self.prefixes: dict[int, np.ndarray] = {}
        if len(self.at):
            grams = mix(rolling_hash(prefix_hash(self.data, _powers[0]), GRAM, _powers[0]))
            trigger = least_at(grams, L - GRAM + 1)[self.at]
            new = np.ones(len(trigger), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (np.diff(self.at) != 1)
            self.head = np.flatnonzero(new)  # first string of each phrase
            self.count = np.diff(np.append(self.head, len(self.at)))
            self.trigger = grams[trigger[new]]
            self.begin = self.at[self.head]
            self.doc = np.searchsorted(self.offsets, self.begin, "right") - 1
            self.mark = self.hash_of(0, self.begin, self.begin + self.count + L - 1) ^ mix(self.count, 5)
        else:
            self.head = self.count = self.begin = self.doc = np.zeros(0, np.int64)
            self.trigger = self.mark = np.zeros(0, U64)

    def hash_of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if which not in self.prefixes:
            self.prefixes[which] = prefix_hash(self.data, _powers[1 + which])
        return mix(range_hash(self.prefixes[which], start, end, _powers[1 + which]), 11 + which)

    def dictionary(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, entry): the first phrase of each distinct one, and each phrase's entry."""
        _, first, entry = np.unique(self.mark ^ mix(self.trigger, 3), return_index=True, return_inverse=True)
        return first, entry


class Poll:
    """A group's distinct triggers by bucket: 31 bits and whether many phrases have it here."""

    def __init__(self, group: Group, first: np.ndarray, buckets: int):
        self.distinct, self.inverse, phrases = np.unique(group.trigger[first], return_inverse=True, return_counts=True)
        _, all_of = np.unique(group.trigger, return_counts=True)
        self.local = all_of > 1
        self.many = phrases > HOT
        bucket = (self.distinct >> U64(31)) % U64(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1).astype(U64))

    def rows(self, grp: int) -> Iterator[tuple[int, int, bytes]]:
        sent = ((self.distinct & U64(0x7FFFFFFF)) | (self.many.astype(U64) << U64(31))).astype("<u4")[self.order]
        for b in np.flatnonzero(np.diff(self.cuts)):
            yield grp, int(b), sent[self.cuts[b] : self.cuts[b + 1]].tobytes()

    def read(self, reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(repeated, hot) of each dictionary entry."""
        again, hot = self.local.copy(), np.zeros(len(self.distinct), bool)
        for b, mask in zip(reply.column("bkt").to_pylist(), reply.column("mask").to_pylist()):
            i = self.order[self.cuts[b] : self.cuts[b + 1]]
            bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=2 * len(i)).astype(bool)
            again[i] |= bits[: len(i)]
            hot[i] = bits[len(i) :]
        return again[self.inverse], hot[self.inverse]


def _tally(table: pa.Table) -> pa.Table:
    vals = [np.frombuffer(x, "<u4") for x in table.column("vals").to_pylist()]
    cuts = np.cumsum([0, *map(len, vals)])
    every = np.concatenate(vals)
    _, inverse, groups = np.unique(every & np.uint32(0x7FFFFFFF), return_inverse=True, return_counts=True)
    many = np.bincount(inverse, every >> np.uint32(31)) > 0
    again, hot = (groups > 1)[inverse], (many | (groups > HOT_GROUPS))[inverse]
    masks = [np.packbits(np.concatenate([again[a:b], hot[a:b]])).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"grp": table.column("grp"), "bkt": table.column("bkt"), "mask": pa.array(masks, pa.binary())})


class Sent:
    """What a group sends to dictionary blocks: whole phrases, and single strings of those with hot triggers."""

    def __init__(self, group: Group, reply: pa.Table, buckets: int, blocks: int):
        self.first, self.entry = group.dictionary()
        again, hot = Poll(group, self.first, buckets).read(reply) if len(self.first) else (np.zeros(0, bool),) * 2
        self.cold = np.flatnonzero(again & ~hot)  # entries
        block = (group.trigger[self.first[self.cold]] >> U64(20)) % U64(blocks)
        self.deal = np.lexsort((self.first[self.cold], block))
        self.cuts = np.searchsorted(block[self.deal], np.arange(blocks + 1).astype(U64))
        # Hot: all strings of the entries, distinct ones with their first document here.
        self.hot = np.flatnonzero(again & hot)
        count = group.count[self.first[self.hot]]
        self.hot_cuts = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(group.begin[self.first[self.hot]] - self.hot_cuts[:-1], count) + np.arange(self.hot_cuts[-1])
        if len(start):
            hi, lo = group.hash_of(0, start, start + L), group.hash_of(1, start, start + L)
        else:
            hi = lo = np.zeros(0, U64)
        order = np.lexsort((start, lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.cumsum(new) - 1
        lead = order[new]
        self.hi, self.lo, self.lead_start = hi[lead], lo[lead], start[lead]
        block = (self.hi >> U64(21)) % U64(blocks)
        self.hot_deal = np.lexsort((self.lead_start, block))
        self.hot_block_cuts = np.searchsorted(block[self.hot_deal], np.arange(blocks + 1).astype(U64))


PHRASES = "grp long, blk int, hot boolean, a binary, b binary, doc binary"
REPLY = "grp long, blk int, hot boolean, mask binary"


def _send(group: Group, sent: Sent, grp: int) -> pa.Table:
    rows = []
    raw = group.data
    packed = zstandard.ZstdCompressor(level=1).compress  # entropy coding halves what is dealt
    for b in np.flatnonzero(np.diff(sent.cuts)):
        p = sent.first[sent.cold[sent.deal[sent.cuts[b] : sent.cuts[b + 1]]]]
        size = group.count[p] + L - 1
        cuts = np.cumsum(size) - size
        at = np.repeat(group.begin[p] - cuts, size) + np.arange(int(size.sum()))
        rows.append((grp, int(b), False, packed(raw[at].tobytes()), group.count[p].astype(np.uint8).tobytes(), group.ids[group.doc[p]].tobytes()))
    for b in np.flatnonzero(np.diff(sent.hot_block_cuts)):
        i = sent.hot_deal[sent.hot_block_cuts[b] : sent.hot_block_cuts[b + 1]]
        start = sent.lead_start[i]
        doc = np.searchsorted(group.offsets, start, "right") - 1
        rows.append((grp, int(b), True, packed(raw[start[:, None] + np.arange(L)].tobytes()), np.ones(len(i), np.uint8).tobytes(), group.ids[doc].tobytes()))
    columns = zip(*rows) if rows else ((),) * 6
    kinds = (pa.int64(), pa.int32(), pa.bool_(), *(pa.binary(),) * 3)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("grp", "blk", "hot", "a", "b", "doc"), columns, kinds)})


def suffix_classes(data: np.ndarray, start: np.ndarray, length: int = L) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each): the suffixes at ``start`` sorted by their first ``length`` bytes.

    Most significant first: eight bytes a round, and only suffixes that are
    still tied with a neighbour are sorted on.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    place = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at: np.ndarray, k: int) -> np.ndarray:
        cells = place[at + k].copy()
        if length - k < 8:
            cells[:, length - k :] = 0
        return cells.view(">u8").ravel().astype(U64)

    order = np.argsort(word(start, 0), kind="stable")
    key = word(start[order], 0)
    cls = np.zeros(len(start), np.int64)
    if len(start):
        cls[1:] = np.cumsum(key[1:] != key[:-1])
    for k in range(8, length, 8):
        same = np.zeros(len(order), bool)
        same[1:] = cls[1:] == cls[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        t = np.flatnonzero(tied)
        if not len(t):
            break
        sub, c = order[t], cls[t]
        key = word(start[sub], k)
        o = np.lexsort((key, c))
        sub, c, key = sub[o], c[o], key[o]
        order[t] = sub
        step = np.zeros(len(order), np.int64)
        step[1:] = np.diff(cls)
        split = np.zeros(len(t), np.int64)
        split[1:] = (c[1:] == c[:-1]) & (key[1:] != key[:-1])
        step[t] += split
        cls = np.cumsum(step)
    return order, cls


def _least_of(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each place's class; classes are consecutive."""
    if not len(cls):
        return doc
    heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    return np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(cls))))


def _block(table: pa.Table) -> pa.Table:
    """One dictionary block: which strings of each sent phrase stand in a smaller document too."""
    unpacked = zstandard.ZstdDecompressor().decompress
    hot, a, b, doc = (table.column(c).to_pylist() for c in ("hot", "a", "b", "doc"))
    docs = [np.frombuffer(x, "<i8") for x in doc]
    cuts = np.cumsum([0, *map(len, docs)])
    docs = np.concatenate(docs)
    data = np.concatenate([np.frombuffer(unpacked(x), np.uint8) for x in a])
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in b]).astype(np.int64)
    size = count + L - 1
    begin = np.cumsum(size) - size
    # The dictionary: equal phrases of several groups once, under their least document.
    prefix = [prefix_hash(data, p) for p in _powers[1:]]
    h1, h2 = (range_hash(x, begin, begin + size, p) for x, p in zip(prefix, _powers[1:]))
    order = np.lexsort((docs, h2, h1, count))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]) | (count[order][1:] != count[order][:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    lead = order[new]
    n = count[lead]
    at = np.cumsum(n) - n
    start = np.repeat(begin[lead] - at, n) + np.arange(int(n.sum()))
    suffix, cls = suffix_classes(data, start)
    least = np.empty(len(start), np.int64)
    least[suffix] = _least_of(cls, np.repeat(docs[lead], n)[suffix])
    # One 32-bit mask an occurrence: a phrase has at most 31 strings.
    j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    bits = np.where(least[np.repeat(at[entry], count) + j] < np.repeat(docs, count), np.left_shift(np.int64(1), j), 0)
    mask = np.add.reduceat(bits, np.cumsum(count) - count)
    masks = [(np.packbits(mask[x:y].astype(bool)) if h else mask[x:y].astype("<u4")).tobytes() for h, x, y in zip(hot, cuts[:-1], cuts[1:])]
    return pa.table({"grp": table.column("grp"), "blk": table.column("blk"), "hot": table.column("hot"), "mask": pa.array(masks, pa.binary())})


def _removed(group: Group, sent: Sent, reply: pa.Table) -> np.ndarray:
    """Which bytes of the group go."""
    masks = np.zeros(len(sent.first), np.int64)  # of each entry, for its first document here
    string_hit = np.zeros(len(sent.hi), bool)
    for b, hot, mask in zip(*(reply.column(c).to_pylist() for c in ("blk", "hot", "mask"))):
        if hot:
            i = sent.hot_deal[sent.hot_block_cuts[b] : sent.hot_block_cuts[b + 1]]
            string_hit[i] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(i)).astype(bool)
        else:
            masks[sent.cold[sent.deal[sent.cuts[b] : sent.cuts[b + 1]]]] = np.frombuffer(mask, "<u4")
    ids = group.ids[group.doc]
    least_here = group.ids[group.doc[sent.first]][sent.entry]
    edge = np.zeros(len(group.data) + 1, np.int32)
    # Phrases of a later document than the group's first one with them go whole.
    whole = np.flatnonzero(ids > least_here)
    np.add.at(edge, group.begin[whole], 1)
    np.add.at(edge, group.begin[whole] + group.count[whole] + L - 1, -1)
    some = np.flatnonzero((ids == least_here) & (masks[sent.entry] != 0))
    count = group.count[some]
    j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    hit = (np.repeat(masks[sent.entry[some]], count) >> j) & 1 == 1
    start = (np.repeat(group.begin[some], count) + j)[hit]
    # Hot entries: each string against its first document here, or a smaller one elsewhere.
    if len(sent.hot):
        number = np.full(len(sent.first), -1, np.int64)
        number[sent.hot] = np.arange(len(sent.hot))
        some = np.flatnonzero((ids == least_here) & (number[sent.entry] >= 0))
        count = group.count[some]
        j = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        s = sent.string[np.repeat(sent.hot_cuts[number[sent.entry[some]]], count) + j]
        first_id = group.ids[np.searchsorted(group.offsets, sent.lead_start[s], "right") - 1]
        hit = string_hit[s] | (first_id < np.repeat(ids[some], count))
        start = np.concatenate([start, (np.repeat(group.begin[some], count) + j)[hit]])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + L, -1)
    return np.cumsum(edge[:-1]) > 0


def _deduped(docs: DataFrame, finish, schema: str) -> DataFrame:
    groups = pieces_for(docs, GROUP_BYTES)
    buckets, blocks = max(16, groups // 16), max(16, groups // 2)
    dealt = with_group(docs.select("doc_id", "text"), groups)

    def vote(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(table)
        rows = list(Poll(group, group.dictionary()[0], buckets).rows(key[0].as_py())) if len(group.at) else []
        columns = zip(*rows) if rows else ((),) * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("grp", "bkt", "vals"), columns, (pa.int64(), pa.int32(), pa.binary()))})

    votes = dealt.groupBy("grp").applyInArrow(vote, "grp long, bkt int, vals binary")
    masks = votes.groupBy("bkt").applyInArrow(_tally, "grp long, bkt int, mask binary")

    def send(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        group = Group(table)
        return _send(group, Sent(group, reply, buckets, blocks), key[0].as_py())

    sent = dealt.groupBy("grp").cogroup(masks.groupBy("grp")).applyInArrow(send, PHRASES)
    replies = sent.groupBy("blk").applyInArrow(_block, REPLY)
    both = masks.select("grp", F.col("bkt").alias("at"), "mask", F.lit(None).cast("boolean").alias("hot")).unionByName(replies.select("grp", F.col("blk").alias("at"), "mask", "hot"))

    def resolve(table: pa.Table, reply: pa.Table) -> pa.Table:
        group = Group(table)
        census = pc.is_null(reply.column("hot"))
        mask = reply.filter(census).select(["at", "mask"]).rename_columns(["bkt", "mask"])
        rest = reply.filter(pc.invert(census)).select(["at", "hot", "mask"]).rename_columns(["blk", "hot", "mask"])
        removed = _removed(group, Sent(group, mask, buckets, blocks), rest) if len(group.at) else np.zeros(len(group.data), bool)
        return finish(group, removed)

    return dealt.groupBy("grp").cogroup(both.groupBy("grp")).applyInArrow(resolve, schema)


def _counts(group: Group, removed: np.ndarray) -> dict[str, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(removed)])
    rise = removed.copy()
    rise[1:] &= ~removed[:-1]
    inner = group.offsets[1:-1]
    inner = inner[inner < len(removed)]
    rise[inner] = removed[inner]
    runs = np.concatenate([[0], np.cumsum(rise)])
    o = group.offsets
    return {"n_bytes": np.diff(o), "n_removed": total[o[1:]] - total[o[:-1]], "n_spans": runs[o[1:]] - runs[o[:-1]]}


def dedup_digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def rows(group: Group, removed: np.ndarray) -> pa.Table:
        o, keep = group.offsets, ~removed
        digest = [hashlib.sha256(group.data[a:b][keep[a:b]].tobytes()).hexdigest() for a, b in zip(o[:-1], o[1:])]
        return pa.table({"doc_id": group.table.column("doc_id"), **{k: pa.array(v.astype(np.int64)) for k, v in _counts(group, removed).items()}, "kept_sha256": pa.array(digest, pa.string())})

    return _deduped(docs, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, kept binary, spans array of [start, end) removed)."""

    def rows(group: Group, removed: np.ndarray) -> pa.Table:
        kept, spans = [], []
        for a, b in zip(group.offsets[:-1], group.offsets[1:]):
            gone = np.diff(np.concatenate([[0], removed[a:b].astype(np.int8), [0]]))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(gone == 1), np.flatnonzero(gone == -1))])
            kept.append(group.data[a:b][~removed[a:b]].tobytes())
        return pa.table({"doc_id": group.table.column("doc_id"), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return _deduped(docs, rows, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")
