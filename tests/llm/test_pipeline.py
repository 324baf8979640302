import random

import duckdb
import pytest

import corpus_pipeline
from filigree.llm import oracles, queries
from filigree.llm.shared import written

from . import brute

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_stages_in_order_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "substring_dedup", "mix_to_weights", "pack"]
    start = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf), name)
        if i < 4:
            assert docs.columns == before.columns
        rows = before.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} <= {d for d, t in start.items() if not brute.quality(t)[5]}
        if name == "minhash_dedup":
            want = brute.near([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in docs.collect()} == {d for d, (_, c) in want.items() if c == d}
        if name == "substring_dedup":
            want = {d: (n, gone) for d, n, gone, _ in brute.substring_words(sorted((r.doc_id, r.text) for r in rows))}
            got = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
            assert got == {d: n - gone for d, (n, gone) in want.items() if gone == 0 or gone < n}
        if name == "mix_to_weights":
            sizes = {}
            for r in rows:
                sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
            taken = dict.fromkeys(sizes, 0)
            for r in docs.collect():
                taken[r.source] += len(brute.words(r.text))
            want = brute.targets(sizes)
            assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
        if name == "pack":
            assert sum(r.length for r in docs.collect()) == sum(r.doc_tokens for r in docs.where("start = 0").collect())


def test_run(spark, sf):
    """The pieces that come out are a cut of what the stages before would have packed, by an independent count."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, sf), name)
    want = sorted((r.doc_id, len(r.text or "")) for r in docs.select("doc_id", "text").collect())
    got = corpus_pipeline.run(spark, sf).collect()
    whole = [r for r in got if r.start == 0]
    assert sorted(r.doc_id for r in whole) == [d for d, _ in want]
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in whole)
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs in ends.values():
        assert [o for o, _ in sorted(runs)] == [sum(n for _, n in sorted(runs)[:i]) for i in range(len(runs))]
        assert sum(n for _, n in runs) <= 4096


def test_rows_without_an_id_go_through_the_stages(spark, sf):
    r = random.Random(4)
    # Words of prose lengths, so that the quality rules let the texts pass.
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = [(None, " ".join(words[:120]), "a"), (None, " ".join(words[130:260]), None), (4, " ".join(words[270:]), "a"), (4, " ".join(words[270:]), "a"), (5, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, sf), name)
        assert {r.text.split()[0] for r in docs.collect()} == {words[0], words[130], words[270]}, name
    assert corpus_pipeline.pack(spark, docs, sf).where("doc_id is null").count() >= 2


def test_minhash_dedup_links_from_80_percent(spark, sf):
    base = [f"w{i}" for i in range(205)]
    # k replaced words take 5 k of 201 shingles each: 91, 82 and 74 % alike.
    texts = [" ".join("other" + w if int(w[1:]) in range(20, 20 + 20 * k, 20) else w for w in base) for k in (0, 2, 4, 6)]
    pairs = [(10 * k + i, t) for k, text in enumerate(texts[1:]) for i, t in enumerate([" ".join(f"{k}{w}" for w in texts[0].split()), " ".join(f"{k}{w}" for w in text.split())])]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    sims = [len(a & b) / len(a | b) for a, b in ((brute.shingles(pairs[i][1]), brute.shingles(pairs[i + 1][1])) for i in (0, 2, 4))]
    assert sims[0] > 0.85 > sims[1] > 0.8 > sims[2]
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, sf).collect()}
    assert got == {d for d, (_, c) in brute.near(pairs, 80).items() if c == d}
