"""The source divergence audit against a dense count in plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filigree.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, rank int, term string"


def brute_audit(rows, least_docs, best):
    sep = {chr(b) for b in range(128) if not chr(b).isalpha()}
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(" " if c in sep else c.lower() if c.isascii() else c for c in text or "")
        terms = [t for t in low.split(" ") if t]
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in in_docs.items()}
    share = lambda n, total, v: 1 + (10**9 * (n + 5)) // (total + 5 * v)
    shares, langs = {}, defaultdict(Counter)
    for (lang, source), c in counts.items():
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        shares[lang, source] = {t: share(c[t], total, v) for t in kept[lang]}
        langs[lang].update({t: c[t] for t in kept[lang]})
    out = set()
    for (lang, source), p in shares.items():
        pairs = [(o, sum(abs(p[t] - shares[lang, o][t]) for t in kept[lang])) for (k, o) in shares if k == lang and o != source]
        total, v = sum(langs[lang].values()), len(kept[lang])
        q = {t: share(langs[lang][t], total, v) for t in kept[lang]}
        terms = [(t, p[t] - q[t]) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= best}
    return out


def corpus():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcXYZéß中") for _ in range(r.randint(1, 3))) for _ in range(120)]
    rows = [(" ,;1\x00\n".join(r.choices(vocab, k=r.randint(0, 60))[:1]) + " " + r.choice("-_@ \x7f").join(r.choices(vocab, k=40)), r.choice(["en", "de", None]), r.choice(["s1", "s2", "S2", "é", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "xx", "lone"), ("a b", "xx", "other"), ("\x00 12 --", "en", "marks"), (" ".join(vocab * 400), "de", "long")]
    rows += [("hot Hot HOT same words", "en", "s1")] * 60
    return rows


@pytest.mark.parametrize(("least_docs", "best"), [(30, 50), (3, 4), (10_000, 50)])
def test_audit_equals_a_dense_count(spark, least_docs, best):
    rows = corpus()
    docs = spark.createDataFrame([(i, *x, 7, "clash") for i, x in enumerate(rows)], DOCS).repartition(4)
    got = [tuple(x) for x in divergence.audit(docs, least_docs, best).collect()]
    want = brute_audit(rows, least_docs, best)
    assert len(got) == len(set(got)) and set(got) == want


def test_shards_do_not_change_the_audit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, *x, 7, "clash") for i, x in enumerate(corpus())], DOCS).repartition(3)
    want = {tuple(x) for x in divergence.audit(docs, 5).collect()}
    monkeypatch.setattr(divergence, "SHARD_BYTES", 3000)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    assert {tuple(x) for x in divergence.audit(docs, 5).collect()} == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_past_64_bits(spark):
    """A count beyond 2**63 / 10**9 still has its exact share."""
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long")
    assert df.select(divergence._share("n", "total")).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)
    assert df.select(F.lit(1)).count() == 1
