"""Substring dedup by relative Lempel-Ziv parsing over word sequences.

The reference is the corpus's first occurrences: every distinct ``k``-word
window stands in it once, where it first starts, in blocks dealt by window hash.
A document is parsed greedily against all blocks that can hold a factor of it.
From the first word on, a window with an earlier place in the reference opens a
factor.  As a window stands only once there, the factor's longest match is found
by going on while the next window's place is the next one of the same source:
no other place of the reference can match longer.  The parse goes on behind
the factor, after a check of the boundary: windows that begin within the
factor's last ``k - 1`` words and reach over its end are looked up as well, and open
a factor of their own, so a match that straddles two factors is not lost.  A
factor has at least ``k`` words; the words of the factors are the duplicate spans.

Two passes keep traffic small.  A census of seeds (minimizers of 8-word grams,
at least one in every window and the same in equal windows) finds the windows
that can occur twice; only those are sent, each once a group of documents, as
128-bit hashes, so shared passages and groups of copies stay balanced.

Defined cases: a null text has no words; texts are parsed whole; documents are
ordered by id, then rows with one id by text, and repeated rows count as later
documents; documents of fewer than ``k`` words keep all; an empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .census import SENT, Ballot, answers, read_masks, sent_table, with_group
from .scan import U64, Words, least_at, slices, text_buffer, window_starts, windows
from .shared import pieces_for

K, GRAM = 20, 8
GROUP_BYTES = 3 << 20
#: No document: first places that are unknown or the window's own.
NONE = np.iinfo(np.int64).min


class Group:
    """The documents of one group in order, and their k-word windows."""

    def __init__(self, table: pa.Table, k: int):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.table = table.take(order).combine_chunks()
        self.ids = np.array(self.table.column("doc_id").fill_null(NONE + 1), np.int64)
        self.data, self.offsets = text_buffer(self.table.column("text"))
        # One slice at a time bounds the scratch arrays; word indexes run through the group.
        hashes, starts, ends, first = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        base = 0
        for lo, hi in slices(self.offsets):
            at = self.offsets[lo]
            words = Words(self.data[at : self.offsets[hi]], self.offsets[lo : hi + 1] - at)
            hashes.append(words.hashes())
            starts.append(words.start + at)
            ends.append(words.end + at)
            first.append(words.first[1:] + base)
            base += len(words.start)
        self.words, self.start, self.end, self.first = map(np.concatenate, (hashes, starts, ends, first))
        self.at = window_starts(self.first, k)
        self.k = k

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """(seeds, run): the grams that are the least of some window's, and which of them each window has."""
        if not len(self.at):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        grams = windows(self.words, GRAM)
        at = least_at(grams, self.k - GRAM + 1)[self.at]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        return grams[at[new]], np.cumsum(new) - 1

    def ballot(self, buckets: int) -> Ballot:
        return Ballot(self.seeds()[0], buckets)

    def candidates(self, masks: dict[int, bytes], buckets: int) -> np.ndarray:
        """Windows whose seed occurs elsewhere: at another place of a text, or in another text."""
        seeds, run = self.seeds()
        return self.at[Ballot(seeds, buckets).repeated(masks)[run]] if len(run) else self.at


class Index:
    """A group's candidate windows: distinct ones with their first place in the group."""

    def __init__(self, group: Group, at: np.ndarray, blocks: int):
        self.at = at
        hi, lo = (windows(group.words, group.k, w)[at] if len(at) else np.zeros(0, U64) for w in (0, 1))
        order = np.lexsort((lo, hi))  # stable: places ascend within equal windows
        new = np.ones(len(at), bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        self.rank = np.empty(len(at), np.int64)  # of each window among the distinct ones
        self.rank[order] = np.cumsum(new) - 1
        self.lead = order[new]  # the first place of each distinct window
        self.hi, self.lo = hi[self.lead], lo[self.lead]
        block = (self.hi >> U64(33)) % U64(blocks)
        # Within a block by place, so that ids lie in runs that compress.
        self.deal = np.lexsort((self.lead, block))
        self.cuts = np.searchsorted(block[self.deal], np.arange(blocks + 1).astype(U64))


INDEX_SENT = "grp long, blk int, hi binary, lo binary, doc binary, pos binary"
FIRST = "grp long, blk int, which binary, doc binary, pos binary"


def _send_index(group: Group, index: Index, grp: int) -> pa.Table:
    at = index.at[index.lead]
    doc = group.doc_of(at)
    ids, pos = group.ids[doc], at - group.first[doc]
    rows = []
    for b in np.flatnonzero(np.diff(index.cuts)):
        i = index.deal[index.cuts[b] : index.cuts[b + 1]]
        rows.append((grp, int(b), index.hi[i].tobytes(), index.lo[i].tobytes(), ids[i].tobytes(), pos[i].astype("<u4").tobytes()))
    columns = zip(*rows) if rows else ((),) * 6
    kinds = (pa.int64(), pa.int32(), *(pa.binary(),) * 4)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("grp", "blk", "hi", "lo", "doc", "pos"), columns, kinds)})


def _first_places(table: pa.Table) -> pa.Table:
    """In one reference block: for each group's windows, those that start earlier in another group, and where first."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    parts = get("hi", "<u8")
    cuts = np.cumsum([0, *map(len, parts)])
    hi, lo = np.concatenate(parts), np.concatenate(get("lo", "<u8"))
    doc, pos = np.concatenate(get("doc", "<i8")), np.concatenate(get("pos", "<u4"))
    row = np.repeat(np.arange(len(parts)), np.diff(cuts))
    order = np.lexsort((row, pos, doc, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    source = np.empty(len(order), np.int64)
    source[order] = lead
    later = source != np.arange(len(order))
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        which = np.flatnonzero(later[a:b])
        if len(which):
            s = source[a + which]
            out.append((table.column("grp")[i].as_py(), table.column("blk")[i].as_py(), which.astype("<u4").tobytes(), doc[s].tobytes(), pos[s].tobytes()))
    columns = zip(*out) if out else ((),) * 5
    kinds = (pa.int64(), pa.int32(), *(pa.binary(),) * 3)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("grp", "blk", "which", "doc", "pos"), columns, kinds)})


class Parse:
    """The greedy factors of a group's documents, and the words they cover."""

    def __init__(self, group: Group, index: Index, places: pa.Table):
        n = len(index.lead)
        lead_at = index.at[index.lead]
        lead_doc = group.doc_of(lead_at)
        # Rows with one id are told apart by their place in the group.
        src_doc, src_pos, outside = group.ids[lead_doc].copy(), (lead_at - group.first[lead_doc]).astype(np.int64), np.zeros(n, bool)
        for blk, which, doc, pos in zip(*(places.column(c).to_pylist() for c in ("blk", "which", "doc", "pos"))):
            i = index.deal[index.cuts[blk] : index.cuts[blk + 1]][np.frombuffer(which, "<u4")]
            src_doc[i], src_pos[i], outside[i] = np.frombuffer(doc, "<i8"), np.frombuffer(pos, "<u4"), True
        own = np.zeros(len(index.at), bool)
        own[index.lead] = True
        found = ~own | outside[index.rank]
        at, rank = index.at[found], index.rank[found]
        doc, pos, text = src_doc[rank], src_pos[rank], group.doc_of(at)
        goes_on = np.zeros(len(at), bool)
        if len(at):
            goes_on[1:] = (np.diff(at) == 1) & (text[1:] == text[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1)
        # A match: where it begins, its last word's end, its source. Each begins behind the last one, or at its boundary.
        begin = np.flatnonzero(~goes_on)
        end = at[begin] + np.diff(np.append(begin, len(at))) + group.k - 1
        #: text (row of the group), start, length in words, source document, source start.
        self.factors = (text[begin], at[begin] - group.first[text[begin]], end - at[begin], doc[begin], pos[begin])
        edge = np.zeros(len(group.words) + 1, np.int32)
        start = group.first[self.factors[0]] + self.factors[1]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.factors[2], -1)
        self.removed = np.cumsum(edge[:-1]) > 0


def _parsed(docs: DataFrame, k: int, finish, schema) -> DataFrame:
    """Runs the passes over docs(doc_id, text, ...) and ``finish(group, parse)`` on each group."""
    groups = pieces_for(docs, GROUP_BYTES)
    buckets, blocks = max(16, groups // 32), max(16, groups // 4)
    dealt = with_group(docs, groups)
    # Each pass groups by the same exchange of the texts.
    def vote(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        return sent_table(list(Group(table, k).ballot(buckets).rows(grp)))

    masks = answers(dealt.groupBy("grp").applyInArrow(vote, SENT))

    def send(key: tuple, table: pa.Table, mask: pa.Table) -> pa.Table:
        group = Group(table, k)
        return _send_index(group, Index(group, group.candidates(read_masks(mask), buckets), blocks), key[0].as_py())

    sent = dealt.groupBy("grp").cogroup(masks.groupBy("grp")).applyInArrow(send, INDEX_SENT)
    places = sent.groupBy("blk").applyInArrow(_first_places, FIRST)
    # Masks and places of a group meet its texts together.
    replies = masks.select("grp", F.col("bkt").alias("at"), F.col("mask").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"), F.lit(False).alias("place")).unionByName(
        places.select("grp", F.col("blk").alias("at"), F.col("which").alias("a"), F.col("doc").alias("b"), F.col("pos").alias("c"), F.lit(True).alias("place"))
    )

    def parse(table: pa.Table, reply: pa.Table) -> pa.Table:
        group = Group(table, k)
        mask = reply.filter(pc.invert(reply.column("place"))).select(["at", "a"]).rename_columns(["bkt", "mask"])
        place = reply.filter(reply.column("place")).select(["at", "a", "b", "c"]).rename_columns(["blk", "which", "doc", "pos"])
        index = Index(group, group.candidates(read_masks(mask), buckets), blocks)
        return finish(group, Parse(group, index, place))

    return dealt.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(parse, schema)


def factors(docs: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, length, source_doc, source_start): all factors, in words."""

    def rows(group: Group, parse: Parse) -> pa.Table:
        text, start, length, doc, pos = parse.factors
        ids = group.table.column("doc_id").combine_chunks().take(pa.array(text))
        return pa.table({"doc_id": ids, **{n: pa.array(np.asarray(c, np.int64)) for n, c in (("start", start), ("length", length), ("source_doc", doc), ("source_start", pos))}})

    return _parsed(docs.select("doc_id", "text"), k, rows, "doc_id long, start long, length long, source_doc long, source_start long")


def _kept_text(group: Group, i: int, removed: np.ndarray) -> bytes:
    a, b = group.first[i], group.first[i + 1]
    raw = group.data[group.offsets[i] : group.offsets[i + 1]].tobytes()
    words = raw.split()
    return b" ".join(words if not removed[a:b].any() else [w for w, gone in zip(words, removed[a:b].tolist()) if not gone])


def dedup_words(docs: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept_text)."""

    def rows(group: Group, parse: Parse) -> pa.Table:
        counts = np.diff(group.first)
        total = np.concatenate([[0], np.cumsum(parse.removed)])
        kept = [_kept_text(group, i, parse.removed) for i in range(len(counts))]
        gone = total[group.first[1:]] - total[group.first[:-1]]
        return pa.table({"doc_id": group.table.column("doc_id"), "n_words": pa.array(counts), "n_removed": pa.array(gone.astype(np.int64)), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return _parsed(docs.select("doc_id", "text"), k, rows, "doc_id long, n_words long, n_removed long, kept_text string")


def dedup_digests(docs: DataFrame, k: int = K) -> DataFrame:
    """As dedup_words, with the kept text's SHA-256 in its place."""

    def rows(group: Group, parse: Parse) -> pa.Table:
        counts = np.diff(group.first)
        total = np.concatenate([[0], np.cumsum(parse.removed)])
        digest = [hashlib.sha256(_kept_text(group, i, parse.removed)).hexdigest() for i in range(len(counts))]
        gone = total[group.first[1:]] - total[group.first[:-1]]
        return pa.table({"doc_id": group.table.column("doc_id"), "n_words": pa.array(counts), "n_removed": pa.array(gone.astype(np.int64)), "kept_sha256": pa.array(digest)})

    return _parsed(docs.select("doc_id", "text"), k, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_table(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with duplicate spans cut out of ``text``; a document left without words goes.

    An untouched text stays as it is; ``n_chars``, where there, is the new text's length.
    """
    # Other columns travel under names that clash with nothing.
    given = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"column {i}" for i, c in enumerate(given)))
    names, at = docs.columns, docs.columns.index("text")

    def rows(group: Group, parse: Parse) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(parse.removed)])
        gone = total[group.first[1:]] - total[group.first[:-1]]
        old = group.table.column("text").to_pylist()
        text = [_kept_text(group, i, parse.removed).decode() if n else old[i] for i, n in enumerate(gone)]
        table = group.table.select(names).set_column(at, "text", pa.array(text, pa.string()))
        if "n_chars" in names:
            i = names.index("n_chars")
            size = pa.array([None if x is None else len(x) for x in text], pa.int64()).cast(table.schema.field(i).type)
            table = table.set_column(i, "n_chars", size)
        return table.filter(pa.array((gone == 0) | (gone < np.diff(group.first))))

    return _parsed(docs, k, rows, docs.schema).toDF(*given)
