import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, component string"


def corpus():
    """Rows with copies, near copies, shared passages, periodic text, nulls, ties and long texts."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéüñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = prose(70)
    texts = [prose(r.randint(1, 220)) for _ in range(30)]
    texts += [prose(40) + " " + passage + "\n" + prose(30) for _ in range(8)]
    texts += [texts[3], texts[3], texts[5].upper(), texts[7] + " tail", ""]
    base = prose(300).split()
    for k in range(14):
        copy = list(base)
        for _ in range(k):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        texts.append(" ".join(copy))
    texts += [None, " \t\n\x0b\x0c\r ", "one", "two words", "a " * 300, "line\nline\nline\n\n \nother", "x" * 5000, "ab" * 1500, "#*$%&|<> ünïcode 🎉 " * 20, prose(6000), "nb sp x \x1c y"]
    texts += ["z " * 30 + prose(30), passage, passage]
    rows = [(3 * i + i % 2, t, "xx", None if i % 7 == 3 else f"s{i % 5}", None if t is None else len(t), i, "c") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
