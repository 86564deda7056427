import random

import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nA line that repeats here\nshort"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "Alpha beta gamma  delta epsilon zeta eta theta.\nA line that repeats here\nshort"),
    (6, "  a LINE that repeats here\t\nanother thing entirely, written at length\n\n"),
    (7, "x" * 20_000 + " " + "word " * 4000),
    (8, "ünïcødé äöü ß 日本語テキスト 😀 ok"),
    (9, "ünïcødé äöü ß 日本語テキスト 😀 ok"),
    (10, "12345 !!! ???"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a very long text, ties and repeats, with further columns whose names clash with inner ones."""
    rows = [(i, t, None if i % 3 == 0 else "en", "src", None, "k", 7, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, shard string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies, a hot group and shared passages."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    hot, passage = prose(60), prose(55)
    texts = []
    for i in range(260):
        kind = i % 5
        if kind == 0:  # near copies of one text
            t = list(hot)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        elif kind == 1:  # different texts with one passage
            t = prose(rnd.randint(5, 120)) + passage + prose(rnd.randint(0, 60))
        elif kind == 2 and texts:
            t = list(texts[rnd.randrange(len(texts))])
            if rnd.random() < 0.6 and t:
                t[rnd.randrange(len(t))] = "edited"
        else:
            t = prose(rnd.randint(0, 90))
        texts.append(t)
    rows = [(1000 + 3 * i, " ".join(t[:20]) + "\n" + " ".join(t[20:])) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows
