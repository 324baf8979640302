import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import chat, fingerprints, mixing, packing, quality, queries, tokens, urls
from filigree.llm.html import Scan, extract

from . import brute

CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_quality_counts(docs, rows):
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_report(docs).collect()}
    assert got == {r[0]: brute.quality(r[1]) for r in rows}


def test_quality_bands(spark):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(900))
    noise = " ".join("".join(chr(33 + r.randrange(90)) for _ in range(30)) for _ in range(300))
    looped = " ".join(f"{w} {i % 7}" for i, w in enumerate(["same", "words", "here"] * 500))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, looped), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality_report(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert [r.doc_id for r in quality.quality_filter(df).collect()] == [1]


def test_quality_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    q = quality.quality_report(docs).join(clean, "doc_id")
    assert q.where("not base_failed and not kept").count() == 0
    assert quality.quality_filter(docs).schema == docs.schema


def test_chat_round_trip(spark):
    hard = ["", "<|", "<||", "<|||im_end|>", queries.FORGED, "a<|turn|>b", "\n", "<|im_end|>\n<|im_start|>user\nhi", "ü🎉"]
    rows = [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "system", "<|x\n|>", None]), random.Random(t * 7 + c).choice([*hard, None]), "clash") for c in range(12) for t in range(c + 1)]
    rows += [(3, 1, "user", "tie", "x"), (3, 1, "user", "tie", "x"), (None, 1, "assistant", "lost", "x"), (5, None, "assistant", "early", "x")]
    df = spark.createDataFrame(rows, CHAT)
    back = chat.read_back(chat.format_chats(df))
    got = {r.conv_id: (len(r.turns), brute.sha("".join(f"{t.role}\n{t.text}\n" for t in r.turns)), len(r.loss_text), brute.sha(r.loss_text)) for r in back.collect()}
    assert got == brute.chats([r[:4] for r in rows])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_merges_neighbours_of_one_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")], CHAT)
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user\na<|turn|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["c"]


URLS = [
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.COM/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/9?q#f", "x.www.example.com", "/en/9", "www.example.com/en/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=/en/", "example.com", "", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("ftp://b.net/es/1#x", "b.net", "/es/1", "net/es/", "block"),
    ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
    ("http://b.net/de/", "b.net", "/de/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://a.org/?u=http://example.com/en/", "a.org", "/", None, "allow"),
    ("http://bad.org/1", "bad.org", "/1", None, "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] + [(100 + i, "http://bad.org/x", "h") for i in range(60)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(11, 0), (None, 1), (3, None), (5, 0)], "page long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels, queries.RULES).collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS]
    none = urls.judge_urls(pages, labels.limit(0), queries.RULES)
    assert none.count() == pages.count() and none.where("rule is null and verdict = 'block'").count() == 0
    assert urls.judge_urls(pages.limit(0), labels, queries.RULES).count() == 0


def test_reputation_shrinks_towards_parents(spark):
    rows = [("a.bad.org", 1)] * 40 + [("b.bad.org", 1)] * 30 + [("b.bad.org", 0)] * 10 + [("new.bad.org", 0)] + [(f"h{i}.good.org", 0) for i in range(50)] + [("lone.net", 1)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.org"].mean > got["b.bad.org"].mean > got["h1.good.org"].mean
    assert got["new.bad.org"].mean > got["h1.good.org"].mean
    assert all(r.low < r.mean for r in got.values())


def test_few_bad_outcomes_dont_block_and_many_do(spark):
    """Fails without shrinkage: a host's own rate alone would block all of these but the clean ones."""
    rows = [(f"h{i}.good.org", int(j == 0)) for i in range(40) for j in range(10)] + [("one.good.org", 1), ("next.good.org", 1)] + [("many.bad.net", int(j % 10 < 8)) for j in range(60)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    blocked = {h for h, r in got.items() if r.low > r.limit}
    assert blocked == {"many.bad.net"}
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(sorted(got))], "page_id long, url string")
    labels = spark.createDataFrame([(sorted(got).index(h), b) for h, b in rows], "page long, bad int")
    judged = {r.host: r.verdict for r in urls.judge_urls(pages, labels, ()).collect()}
    assert {h for h, v in judged.items() if v == "block"} == blocked


def test_beta_bound(spark):
    """Against the integral of the beta density."""
    pairs = [(a, b) for a in (0.05, 1.0, 2.5, 20.0, 400.0) for b in (0.7, 3.0, 50.0, 9000.0)]
    got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", urls.beta_low(F.col("a"), F.col("b"), 0.8).alias("low")).collect()
    t = np.linspace(0, 1, 400_001)[1:-1]
    for r in got:
        log = (r.a - 1) * np.log(t) + (r.b - 1) * np.log1p(-t)
        mass = np.cumsum(np.exp(log - log.max()))
        exact = t[np.searchsorted(mass, 0.2 * mass[-1])]
        assert r.low == pytest.approx(exact, abs=0.02, rel=0.02 if r.a >= 2.5 and r.b >= 3 else 1), (r, exact)


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.y.com", "y.com", "com"), ("y.com:80", "y.com", "com"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost"), ("a.b.com.mx", "b.com.mx", "com.mx"), ("x.co.example", "co.example", "example")])
def test_registered_domain(spark, host, domain, suffix):
    d, s = urls.domain_of(F.lit(host))
    assert tuple(spark.range(1).select(d, s).first()) == (domain, suffix)


def test_mix_targets_and_limits(docs, rows):
    documents, pieces = mixing.mix_sources(docs)
    got = documents.join(pieces.groupBy("doc_id", "row_hash", "copy").agg(F.sum("length").alias("taken")), ["doc_id", "row_hash", "copy"], "left").collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(brute.words({x[0]: x[1] for x in rows}[r.doc_id])) and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert (r.taken or 0) <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken or 0
    assert all(abs(taken[s] - want[s]) <= max(2, 0.002 * want[s]) for s in sizes)


def test_mix_pieces_are_disjoint_within_a_pass_and_shards_even(spark, docs):
    m = mixing.Mix(block_words=16, shard_blocks=8)
    _, pieces = mixing.mix_sources(docs, m=m)
    p = [r.asDict() for r in pieces.collect()]
    assert sorted(map(str, p)) == sorted(str(r.asDict()) for r in mixing.mix_sources(docs, m=m)[1].collect())
    seen = set()
    for r in p:
        for w in range(r["start"], r["start"] + r["length"]):
            key = (r["doc_id"], r["row_hash"], r["copy"], r["epoch"], w)
            assert key not in seen
            seen.add(key)
    shards = np.bincount([r["shard"] for r in p], [r["length"] for r in p])
    assert len(shards) >= 64 and shards.max() <= 16 * 16


@pytest.mark.parametrize("rows,taken", [([], None), ([(1, None, None)], 0), ([(1, "a b c", None), (1, "a b c", None)], 6), ([(1, "w", "x"), (2, "", "y"), (3, "p q", None)], 3)])
def test_mix_small_cases(spark, rows, taken):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, pieces = mixing.mix_sources(df)
    assert documents.count() == len(rows)
    # A target is met to the word, so the sum may be off by one a source.
    assert abs((pieces.agg(F.sum("length")).first()[0] or 0) - (taken or 0)) <= (1 if len(rows) > 2 else 0)


def test_hypergeometric_draws(spark):
    from math import comb

    n = 4000
    k = spark.range(n).select(mixing.hypergeometric(F.lit(12), F.lit(20), F.lit(9), mixing.uniform("id")).alias("k")).groupBy("k").count().collect()
    got = {r.k: r["count"] for r in k}
    chi = sum((got.get(i, 0) - e) ** 2 / e for i in range(10) if (e := n * comb(12, i) * comb(20, 9 - i) / comb(32, 9)) > 5)
    assert chi < 30
    edge = spark.range(1).select(*(mixing.hypergeometric(*map(F.lit, a), F.lit(0.5)).alias(str(i)) for i, a in enumerate([(0, 5, 3), (5, 0, 3), (4, 4, 0), (4, 4, 8)]))).first()
    assert tuple(edge) == (0, 3, 0, 4)


def test_splitting_tree_draws_are_multivariate_hypergeometric(spark):
    from itertools import product
    from math import comb

    quotas = spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "rank int, draws long")
    for seed in range(4):
        got = {}
        for r in mixing.splitting_tree(quotas, 1, mixing.Mix(seed=seed)).collect():
            got.setdefault(r.shard, {})[r["rank"]] = r["take"]
        assert {sum(x.values()) for x in got.values()} == {6}
        assert [sum(x.get(k, 0) for x in got.values()) for k in (1, 2, 3)] == [5, 4, 3]
    n = 4000
    have = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "draws"))).alias("have"))
    draws = spark.range(n).crossJoin(have).select(mixing.split_draws(F.col("have"), F.col("id")).alias("left"))
    counts = {tuple(r.left): r["count"] for r in draws.groupBy("left").count().collect()}
    want = {k: n * comb(5, k[0]) * comb(4, k[1]) * comb(3, k[2]) / comb(12, 6) for k in product(range(6), range(5), range(4)) if sum(k) == 6}
    assert set(counts) <= set(want) and sum(counts.values()) == n
    big = {k: e for k, e in want.items() if e > 5}
    chi = sum((counts.get(k, 0) - e) ** 2 / e for k, e in big.items())
    assert chi < len(big) + 4 * (2 * len(big)) ** 0.5


@pytest.mark.parametrize("n", [1, 2, 3, 7, 18, 93, 500])
def test_permuted_is_a_bijection_that_changes_with_its_key(spark, n):
    got = spark.range(n).select("id", *(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k)).alias(f"k{k}") for k in range(3))).collect()
    orders = [[r[f"k{k}"] for r in got] for k in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 10:
        assert len(set(map(tuple, orders))) == 3
        # No rotation: steps from one place to the next differ.
        assert all(len({(b - a) % n for a, b in zip(o, o[1:])}) > n // 4 for o in orders)


def test_mixed_table_lies_in_the_shards_order(spark, docs, rows):
    m = mixing.Mix(block_words=64, shard_blocks=8)
    _, pieces = mixing.mix_sources(docs, m=m)
    place, runs = {}, {}
    for r in sorted(pieces.collect(), key=lambda r: r["start"]):
        place.setdefault((r.doc_id, r["copy"], r.epoch), (r["shard"], r.order_key))
        runs.setdefault((r.doc_id, r["copy"], r.epoch), []).append((r["start"], r["length"]))
    source = {r[0]: brute.words(r[1]) for r in rows}
    at = {}
    for (d, _, _), where in place.items():
        at.setdefault(d, set()).add(where[0])
    mixed = mixing.mixed_table(docs, m).withColumn("part", F.spark_partition_id()).collect()
    assert len(mixed) == len(place)
    text = {}
    for (d, _, _), x in runs.items():
        text.setdefault(d, []).append(" ".join(w for s, n in x for w in source[d][s : s + n]))
    got = {}
    for r in mixed:
        got.setdefault(r.doc_id, []).append(" ".join(brute.words(r.text)))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in text.items()}
    # Some order of the possible shards never falls inside a partition.
    for part in {r.part for r in mixed}:
        last = -1
        for r in mixed:
            if r.part == part:
                last = min(s for s in at[r.doc_id] if s >= last)
    assert len({where[0] for where in place.values()}) > 8


def test_mix_keeps_null_keys_and_clashing_columns(spark):
    names = ["row", "row_hash", "copy", "pass", "passes", "shard", "rank", "size", "order_key", "epoch", "by_copy"]
    ddl = "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names)
    values = list(range(len(names)))
    rows = [(None, "a b c", "x", *values), (None, "d e", "x", *values), (1, "f", None, *values), (1, "f", None, *values), (2, None, "x", *values)]
    df = spark.createDataFrame(rows, ddl)
    out = mixing.mixed_table(df).collect()
    assert {tuple(r)[3:] for r in out} == {tuple(values)}
    got = sorted((str(r.doc_id), r.text, r.source) for r in out)
    assert {x for x in got if x[0] == "None"} == {("None", "a b c", "x"), ("None", "d e", "x")}
    documents, pieces = mixing.mix_sources(df)
    taken = documents.join(pieces.groupBy(*mixing.ROW).agg(F.sum("length").alias("taken")), mixing.ROW, "left").collect()
    assert len(taken) == 5 and all((r.taken or 0) > 0 for r in taken if r["size"])


def test_mixed_table(spark, docs):
    out = mixing.mixed_table(docs)
    assert out.columns == docs.columns
    want = docs.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert abs(out.select(F.sum(mixing.words_in(F.col("text")))).first()[0] - want) <= 8


def test_tokens_match_the_tokenizer(rows):
    t = tokens.tokenizer(tokens.default_path())
    texts = [r[1] for r in rows] + ["it's we'll I'd", "ΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "é ñ Å İ ǅ", "１２ ½ a1b2", "don't—stop…", "  \x00 a\x1cb \x85", "日本 🙂🙂 한국어 é e\u0301", None]
    for some in (texts, texts[-6:-1], [None], []):
        ids, cuts = t.texts(pa.array(some, pa.string()))
        for i, x in enumerate(some):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == t.whole.encode(x or "", add_special_tokens=False).ids, (x or "")[:50]



def test_packing(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 14)
    t = tokens.tokenizer(tokens.default_path())
    got = packing.pack(docs).collect()
    ids = {r[0]: [*t.whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, runs in by_doc.items():
        at = 0
        for s, n in sorted(runs):
            assert s == at and n > 0
            at += n
        assert at == len(ids[d])
    assert set(by_doc) == set(ids)
    padding = 0
    for runs in by_sequence.values():
        at = 0
        for o, n in sorted(runs):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_retrieval_prefers_alike_documents():
    ids = np.array([5, 6, 7, 2, 100, 101, 2, 5, 6, 8, 2, 100, 102, 2], np.uint16)
    index = packing.Index(ids, np.array([0, 4, 7, 11, 14]))
    assert index.neighbours(0).tolist() == [2] and index.neighbours(1).tolist() == [3]


def test_windows_keep_copies_apart():
    r = np.random.default_rng(3)
    texts = [r.integers(10, 60, 40).tolist() + [2] for _ in range(12)]
    docs = texts * 3
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    alike = np.arange(len(docs)) % 12
    windows = packing.windows_of(packing.Index(np.array(sum(docs, []), np.uint16), cuts), np.diff(cuts), alike, window=100)
    assert sum(n for w in windows for _, _, n in w) == cuts[-1]
    # Three passes over each of twelve texts; the seeds' own rests are left, which may run out of others.
    twice = [k for k, w in enumerate(windows) if len({int(alike[d]) for d, _, _ in w}) < len({d for d, _, _ in w})]
    assert not twice or min(twice) >= len(windows) - 2


def test_packing_small_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(df).collect()) == 5
    assert packing.pack(df.limit(0)).count() == 0


def test_fingerprints(docs, rows):
    got = sorted(fingerprints.compare_neighbours(docs).collect(), key=lambda r: r.doc_id)
    order = sorted((r[0], r[1] or "") for r in rows)
    assert [r.doc_id for r in got] == [d for d, _ in order]
    for i, (r, (_, text)) in enumerate(zip(got, order)):
        other = order[(i + 1) % len(order)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == brute.sha(edited)
        a, b, c = (fingerprints.chunk_set(x.encode()) for x in (text, edited, other))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.spelled(a), fingerprints.spelled(b))
        assert (r.near_edited, r.near_next) == (fingerprints.containment(a, b), fingerprints.containment(a, c))
        if len(text) > 2000 and len(set(text.split())) > 50:
            assert r.near_edited > 0.5


def test_fingerprints_against_a_byte_at_a_time(docs, rows):
    m = fingerprints
    ends = lambda raw: brute.gear_chunks(raw, [int(x) for x in m.GEAR], m.LEAST, m.NORMAL, m.MOST, int(m.STRICT), int(m.LOOSE))
    order = sorted((r[0], r[1] or "") for r in rows if len(r[1] or "") < 3000)
    df = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    got = {r.doc_id: r for r in m.compare_neighbours(df).collect()}
    assert set(got) == {d for d, _ in order}
    spelled = {}
    for i, (d, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        n = len(text) // 4
        a, b, c = (x.encode() for x in (text, text[: len(text) - n] + other[:n], other))
        assert ends(a) == m.boundaries(a)
        assert got[d].near_edited == pytest.approx(brute.contained(a, ends(a), b, ends(b)))
        assert got[d].near_next == pytest.approx(brute.contained(a, ends(a), c, ends(c)))
        # Fingerprints are equal where the sets of chunks are.
        spelled.setdefault(frozenset(a[x:y] for x, y in zip([0, *ends(a)], ends(a))), set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in spelled.values()) and len({f for x in spelled.values() for f in x}) == len(spelled)


def test_quality_verdicts_against_plain_python(spark, docs, rows):
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
    more = [" ".join(word() for _ in range(n)) for n in (49, 50, 90, 300, 700, 900, 1500, 3000)]
    more += [" ".join([word()] * 20 + [word() for _ in range(n)]) for n in (40, 200, 600)]
    noise = lambda n: "".join(chr(r.randrange(33, 126)) + " " * (r.random() < 0.2) for _ in range(n))
    more += [noise(n) for n in (400, 3000, 9000)] + [more[5] + " " + noise(2500), more[6] + " " + ("same again and over " * 300)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {x[0]: x[1] for x in rows} | {10_000 + i: t for i, t in enumerate(more)}
    got = {x.doc_id: x.kept for x in quality.quality_report(df).collect()}
    assert got == {d: brute.compression_kept(t, quality.Bands()) for d, t in texts.items()}
    assert len(set(got[d] for d in got if d >= 10_000)) == 2


def test_host_votes(spark):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    old = lambda k: f"<body><div class='post'><p>{text(k)}</p></div><div class='more7'><p>{text(k + 500)[:20]}</p></div></body>"
    new = lambda k: f"<body><section class='story'><p>{text(k)}</p></section></body>"
    rows = [(i, f"http://a.org/{i}", old(i)) for i in range(5)] + [(10, "http://a.org/x", new(10)), (11, "http://b.org/", new(11)), (12, "http://b.org/2", old(12)), (13, None, old(13)), (14, "http://a.org/y", None)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # The majority's path reads its pages; a page without it has its own; other hosts don't vote.
    assert {got[i].path for i in range(5)} == {"/body/div.post"} and all(got[i].text == text(i) for i in range(5))
    assert got[10].text == text(10) and got[13].text == text(13) and got[14].text == ""
    # A tie goes to the path that sorts first; each page still has its article.
    assert got[11].text == text(11) and got[12].text == text(12)


def test_clashing_names_and_very_long_texts(spark):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long, "s", 5, "p"), (2, long, "s", 6, "q"), (3, "short", None, 7, "r")], "doc_id long, text string, source string, host int, path string")
    packed = packing.pack(df).collect()
    assert len({x.doc_tokens for x in packed if x.doc_id < 3}) == 1 and sum(x.length for x in packed) == sum(x.doc_tokens for x in packed if x.start == 0)
    prints = {x.doc_id: x for x in fingerprints.compare_neighbours(df).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint and prints[1].near_next == 1.0 and abs(prints[1].near_edited - 0.75) < 0.01
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and {x.host for x in kept.collect()} <= {5, 6, 7}
    page = f"<body><article><p>{long}</p></article></body>"
    pages = spark.createDataFrame([(1, "http://a/b", page, 3)], "page_id long, url string, html string, host int")
    assert extract(pages).first().text == long


@pytest.mark.parametrize("part", [1 << 8, 1 << 12])
def test_fingerprints_over_many_ranges(docs, monkeypatch, part):
    whole = sorted(map(tuple, fingerprints.compare_neighbours(docs).collect()))
    monkeypatch.setattr(fingerprints, "PART_BYTES", part)
    assert sorted(map(tuple, fingerprints.compare_neighbours(docs).collect())) == whole


@pytest.mark.parametrize("rows,near", [([], []), ([(7, "abc")], [1.0]), ([(1, None), (None, "x"), (1, "")], [0.0, 1.0, 0.0])])
def test_fingerprints_small_cases(spark, rows, near):
    got = fingerprints.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.near_next for r in got) == sorted(near)


def test_chunks_resist_shifts():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)).encode()
    a, b = fingerprints.chunk_set(text), fingerprints.chunk_set(b"inserted words " + text)
    assert fingerprints.containment(a, b) > 0.95
    ends = fingerprints.boundaries(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST - 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and so on, accept them all please now</div>
<div class="ad-12">Buy &amp; buy</div><article class="post-77"><h1>Head &amp; line</h1><p><b>One<br>two&nbsp;three<p>Four <a href="x">five</a>   six &lt;7&gt;</p><ul><li>li one<li>li two</ul>
<aside>Related things</aside><form><p>Your name</p></form><table><tr><td>cell</td></tr></table></article><section class="comments"><p>A reader says a lot of words here, more than anything else on this page, on and on and on and on and on.</p></section><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    want = "Head & line One two three Four five six <7> li one li two cell"
    assert Scan(PAGE).text(Scan(PAGE).best()) == want
    rows = [(1, "http://a.com/1", PAGE, "t"), (2, "http://a.com/2", PAGE.replace("post-77", "post-8"), "t"), (3, None, None, "t"), (4, "http://a.com/3", "", "t"), (5, "x", "<p>only", "t"), (5, "x", "<p>only", "t"), (6, "http://a.com/4", "<article><p>cut &am", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text == {1: want, 2: want, 3: "", 4: "", 5: "only", 6: "cut &am"}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_on_given_pages(spark, sf):
    import html
    import re

    got = {r.page_id: r.text for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_quality_judges_every_chunk(spark):
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(9000))
    noise = " ".join("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(63)) for _ in range(300))
    # Under two chunks; the bad bytes in a short last chunk; a long text whose last chunk is short; clean texts with tails of all lengths.
    rows = [(1, prose[:4096] + noise[:3904]), (2, noise[:4096] + prose[:3000]), (3, prose[:4096] + noise[:4096] + prose[:30])]
    rows += [(100 + n, prose[n : 2 * n + 4096]) for n in (1, 9, 40, 64, 65, 128, 129, 256, 257, 512, 513, 2048, 2049, 3904)]
    got = {x.doc_id: (x.kept, x.n_chunks) for x in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, 2), 2: (False, 2), 3: (False, 3)} | {d: (True, 2) for d, _ in rows[3:]}


def test_retrieval_scores_every_term():
    r = random.Random(6)
    tokens_ = [[r.randrange(3, 400) for _ in range(r.randint(1, 600))] for _ in range(60)]
    # Fifty terms of great weight, shared in pairs, before the hundreds that 0 and 1 share.
    tokens_[0] = [*range(1000, 1050)] * 5 + [*range(2000, 2300)]
    tokens_[1] = [*range(2000, 2300)]
    tokens_[2] = [*range(1000, 1050)] * 5
    cuts = np.cumsum([0, *(len(x) + 1 for x in tokens_)])
    index = packing.Index(np.array([t for x in tokens_ for t in [*x, 2]], np.uint16), cuts)
    size = [len(x) + 1 for x in tokens_]
    df = {}
    for x in tokens_:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    for seed in range(len(tokens_)):
        score = {}
        for d, x in enumerate(tokens_):
            for t in set(tokens_[seed]) & set(x) if d != seed else ():
                tf, idf = x.count(t), np.log1p((len(size) - df[t] + 0.5) / (df[t] + 0.5))
                score[d] = score.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / np.mean(size)))
        got = index.neighbours(seed).tolist()
        assert set(got) == set(score)
        assert np.allclose([score[d] for d in got], sorted(score.values(), reverse=True))


def test_packing_brings_copies_and_near_copies_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 13)
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(r.choice(vocab) for _ in range(120)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t if i % 2 else t + " tail") for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards = {}
    for x in got:
        shards.setdefault(x.doc_id, set()).add(x.sequence_id >> 32)
    assert len(set.union(*shards.values())) > 8
    assert sum(bool(shards[i] & shards[1000 + i]) for i in range(150)) > 120


def test_html_keeps_the_whole_article(spark):
    body = "<p>" + "long body text, line after line. " * 30 + "</p>"
    page = f"<body><article><h1>Heading</h1><p>intro</p><div class=body>{body}</div></article></body>"
    assert Scan(page).text(Scan(page).best()).startswith("Heading intro long body")
    # The host votes for article/section, which holds little of one of its pages.
    voted = f"<body><div class=post><section>{body}</section></div></body>"
    odd = f"<body><div class=post>{body}<section><p>small end</p></section></div></body>"
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(1, "http://a.com/1", voted), (2, "http://a.com/2", voted), (3, "http://a.com/3", odd), (4, "http://b.com/1", page)], "page_id long, url string, html string")).collect()}
    assert got[3].startswith("long body") and got[3].endswith("small end") and got[4].startswith("Heading intro long body")


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page-header-menu"])
@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_html_layout_wrappers_are_no_furniture(name, tag):
    page = f"<body><div class='{name}'><{tag}><h1>Title</h1><p>{'words of the page ' * 20}</p></{tag}><div class=sidebar><p>aside text</p></div></div></body>"
    assert Scan(page).text(Scan(page).best()) == "Title " + ("words of the page " * 20).strip()


def test_html_inner_marks_stay_furniture():
    page = f"<body><article><p>{'story ' * 20}</p></article><div class=related><article><p>teaser one</p></article></div></body>"
    assert Scan(page).text(Scan(page).best()) == ("story " * 20).strip()


def test_deep_nesting_takes_room_in_proportion():
    """50,000 nested tags: paths, marks and stack stay linear in the page."""
    import tracemalloc

    deep = "<div class='ad layout'>" * 50_000 + "<p>word</p></section></b>" * 50_000
    tracemalloc.start()
    found = Scan(deep)
    best = found.best()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and len(found.steps) == 50_001 and found.text(best) == " ".join(["word"] * 50_000)


@pytest.mark.parametrize("mark", ["class='side-effects'", "class='share-price'", "id='social-history'", "class='related-work'", "class='noticed banner-year'", "class='header'", "class='w-1/2 sidebars-x'"])
def test_names_that_only_contain_furniture_words_stay(mark):
    page = f"<body><article><h1>Title</h1><p>{'story ' * 30}</p><section {mark}><p>these words stay</p></section></article></body>"
    assert "these words stay" in Scan(page).text(Scan(page).best())


@pytest.mark.parametrize("mark", ["class='ad'", "class='related-posts'", "id='comments'", "class='comment-list'", "class='shareButtons'", "class='x cookie-notice'", "class='ad-slot-3'", "class='newsletter__signup'"])
def test_names_made_of_furniture_words_go(mark):
    page = f"<body><article><h1>Title</h1><p>{'story ' * 30}</p><div {mark}><p>these words go</p></div></article></body>"
    assert "these words go" not in Scan(page).text(Scan(page).best())
