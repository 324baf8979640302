import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import scan, sketches, substrings, suffixes

from . import brute


def pairs(rows):
    return sorted((r[0], r[1]) for r in rows)


def test_words_against_brute_force(docs, rows):
    got = sorted(map(tuple, substrings.dedup_digests(docs).collect()))
    assert got == sorted(brute.substring_words(sorted((r[0], r[1]) for r in rows)))
    assert any(r[2] for r in got)


def test_words_text_and_table(docs, rows):
    want = {d: n for d, _, n, _ in brute.substring_words(pairs(rows))}
    old = dict(pairs(rows))
    table = {r.doc_id: r for r in substrings.dedup_table(docs).collect()}
    assert substrings.dedup_table(docs).schema == docs.schema
    for d, n in want.items():
        w = len(brute.words(old[d]))
        assert (d in table) == (n == 0 or n < w)
        if d in table:
            assert len(brute.words(table[d].text)) == w - n
            assert n or table[d].text == old[d]
            assert table[d].n_chars == (None if old[d] is None else len(table[d].text))
    text = {r.doc_id: r.kept_text for r in substrings.dedup_words(docs).collect()}
    assert all(brute.sha(text[d]) == s for d, _, _, s in brute.substring_words(pairs(rows)))


def test_factors_are_copies_of_their_sources(docs, rows):
    split = {d: brute.words(t) for d, t in pairs(rows)}
    found = substrings.factors(docs).collect()
    assert found
    for f in found:
        here = split[f.doc_id][f.start : f.start + f.length]
        assert f.length >= 20 and here == split[f.source_doc][f.source_start : f.source_start + f.length]
        assert (f.source_doc, f.source_start) < (f.doc_id, f.start)


def test_factors_are_the_greedy_longest_matches(docs, rows):
    got = sorted((f.doc_id, f.start, f.length, f.source_doc, f.source_start) for f in substrings.factors(docs).collect())
    assert got == sorted(brute.greedy_factors(pairs(rows)))
    assert any(n > 40 for _, _, n, _, _ in got)
    # What the factors cover is what is removed.
    covered = {}
    for d, start, n, _, _ in got:
        covered.setdefault(d, set()).update(range(start, start + n))
    removed = {r.doc_id: r.n_removed for r in substrings.dedup_digests(docs).collect()}
    assert {d: len(x) for d, x in covered.items()} == {d: n for d, n in removed.items() if n}


def test_clashing_columns_stay(spark):
    text = " ".join(str(i) for i in range(40))
    df = spark.createDataFrame([(1, 777, text, "m"), (2, 778, text + " more", None)], "doc_id long, grp int, text string, mask string")
    got = {r.doc_id: r for r in substrings.dedup_table(df).collect()}
    assert (got[1].grp, got[1].mask, got[2].grp, got[2].mask, got[2].text) == (777, "m", 778, None, "more")


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(str(i) for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substrings.dedup_digests(df).collect())
    assert got == [(40, 0), (40, 40), (40, 40)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffixes.dedup_digests(df).collect())
    assert got == [(-1, 0), (1, len(text)), (1, len(text))]


def test_bytes_against_brute_force(docs, rows):
    got = sorted(map(tuple, suffixes.dedup_digests(docs).collect()))
    assert got == sorted(brute.substring_bytes(pairs(rows)))
    kept = {r.doc_id: (r.kept, r.spans) for r in suffixes.dedup_bytes(docs).collect()}
    for d, n, gone, spans, digest in got:
        assert brute.sha(bytes(kept[d][0])) == digest
        assert len(kept[d][1]) == spans and sum(s.end - s.start for s in kept[d][1]) == gone


@pytest.mark.parametrize("hot,hot_groups", [(256, 4096), (0, 0), (1, 3)])
def test_hot_triggers_give_the_same(rows, monkeypatch, hot, hot_groups):
    """The passes of several groups in one process, with triggers sent by strings or not."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_GROUPS", hot_groups)
    buckets, blocks, n = 3, 4, 5
    parts = [[r for r in rows if r[0] % n == g] for g in range(n)]
    groups = [suffixes.Group(pa.table({"doc_id": pa.array([r[0] for r in p], pa.int64()), "text": pa.array([r[1] for r in p], pa.string())})) for p in parts]
    votes = [x for g, group in enumerate(groups) for x in suffixes.Poll(group, group.dictionary()[0], buckets).rows(g)]
    by = lambda t, c, v: t.filter(pc.equal(t.column(c), v))
    votes = pa.table({"grp": pa.array([v[0] for v in votes], pa.int64()), "bkt": pa.array([v[1] for v in votes], pa.int32()), "vals": pa.array([v[2] for v in votes], pa.binary())})
    masks = pa.concat_tables([suffixes._tally(by(votes, "bkt", b)) for b in range(buckets) if by(votes, "bkt", b).num_rows])
    sent = [suffixes.Sent(group, by(masks, "grp", g), buckets, blocks) for g, group in enumerate(groups)]
    dealt = pa.concat_tables([suffixes._send(group, s, g) for g, (group, s) in enumerate(zip(groups, sent))])
    assert (hot > 1) == (not any(dealt.column("hot").to_pylist()))
    replies = pa.concat_tables([suffixes._block(by(dealt, "blk", b)) for b in range(blocks) if by(dealt, "blk", b).num_rows])
    got = []
    for g, (group, s) in enumerate(zip(groups, sent)):
        removed = suffixes._removed(group, s, by(replies, "grp", g))
        counts = suffixes._counts(group, removed)
        for i, d in enumerate(group.ids.tolist()):
            a, b = group.offsets[i : i + 2]
            got.append((d, *(int(counts[c][i]) for c in ("n_bytes", "n_removed", "n_spans")), brute.sha(group.data[a:b][~removed[a:b]].tobytes())))
    assert sorted(got) == sorted(brute.substring_bytes(pairs(rows)))


def test_many_small_groups_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2048)
    got = sorted(map(tuple, substrings.dedup_digests(docs).collect()))
    assert got == sorted(brute.substring_words(pairs(rows)))


@given(st.lists(st.text("ab", min_size=0, max_size=90), max_size=5))
@settings(max_examples=60, deadline=None)
def test_suffix_classes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    start = np.arange(max(0, len(data) - 49))
    order, cls = suffixes.suffix_classes(data, start)
    keys = [data[i : i + 50].tobytes() for i in start]
    assert [keys[i] for i in order] == sorted(keys)
    assert all((keys[order[i]] == keys[order[i + 1]]) == (cls[i] == cls[i + 1]) for i in range(len(order) - 1))


@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 14))
@settings(max_examples=80, deadline=None)
def test_sliding_minimum_and_place(values, w):
    v = scan.mix(np.array(values, np.uint64)) if values else np.zeros(0, np.uint64)
    got = scan.sliding_min(v, w)
    assert got.tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]
    assert [int(x) for x in scan.least_at(v, w)] == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


def test_near_duplicates_against_brute_force(docs, rows):
    want = brute.near(pairs(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketches.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_cells_find_what_pivots_miss(docs, rows, monkeypatch):
    """Without any link from the pivots all links come from the cells."""
    real = sketches._confirmed
    monkeypatch.setattr(sketches, "_confirmed", lambda pairs, sets, percent: real(pairs.limit(0), sets, percent))
    monkeypatch.setattr(sketches, "CELL_DOCS", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketches.near_duplicates(docs).collect()}
    assert got == brute.near(pairs(rows))


def test_near_duplicates_without_ids_and_with_one_id_twice(spark):
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join(f"x{w}" for w in words)
    rows = [(None, one), (None, one), (7, one), (7, two), (8, one), (9, two), (9, two), (10, None)]
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    # An id is one document whatever its texts, so what is equal to either of them is in its group.
    assert {r.component_id for r in got if r.doc_id in (7, 8, 9)} == {7} and {r.component_id for r in got if r.doc_id == 10} == {10}


def test_every_sketch_coordinate_is_filled_and_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:400], r.integers(0, 1 << 63, 100).astype(np.uint64)]))
    one = a[:1]
    values, cuts = np.concatenate([a, b, one]), np.cumsum([0, len(a), len(b), 1])
    s = sketches.fast_sketch(values, cuts)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_empty_tables(no_docs):
    assert substrings.dedup_digests(no_docs).count() == 0
    assert substrings.dedup_table(no_docs).count() == 0
    assert suffixes.dedup_digests(no_docs).count() == 0
    assert sketches.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("local", [0, 50_000])
@pytest.mark.parametrize("links,want", [([], {}), ([(1, 2), (2, 3), (9, 8)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, monkeypatch, links, want, local):
    monkeypatch.setattr(sketches, "LOCAL_LINKS", local)
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.id: r.component for r in sketches.components(df).collect()} == want
