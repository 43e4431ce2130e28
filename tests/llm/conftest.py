"""Documents with everything that must not break an operator."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, rank string, `key` string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(4)
    en = "the of and house river walked slowly over green hills with a small dog that barked".split()
    fr = "le la les de des maison rivière marchait sur une colline verte avec petit chien qui aboyait".split()
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "word " * 3000), (6, "é" * 5000)]
    base = prose(rng, 120, en).split()
    for i in range(7, 11):  # copies and near copies
        near = base[:]
        for _ in range(i - 7):
            near[rng.randrange(len(near))] = f"x{i}{rng.random():.3f}"
        out.append((i, " ".join(near)))
    out += [(11, " ".join(base)), (11, " ".join(base)), (None, "a row without an id " * 20), (12, "mail bob@example.com now"), (13, "token = abcdef123456 and 10.0.0.1")]
    out += [(i, prose(rng, rng.randint(60, 200), en if i % 3 else fr)) for i in range(14, 44)]
    langs = [None, "en", "fr"]
    return [(i, t, "fr" if i and i >= 14 and i % 3 == 0 else langs[(i or 0) % 2], None if (i or 0) % 7 == 0 else f"s{(i or 0) % 4}", 0, "clash", "clash", "clash") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
