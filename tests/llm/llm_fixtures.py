"""Fixtures of the tests in this folder."""

import os
import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    """Texts of few different words, so that passages repeat, with the awkward ones among them."""
    draw = random.Random(7)
    pool = ["red", "blue", "été", "naïve", "a", "bb", "ccc", "to", "from", "house", "漢字", "x" * 40]
    line = lambda n: " ".join(draw.choice(pool) for _ in range(n))
    shared = [line(30) for _ in range(4)]
    texts = [line(draw.randrange(0, 40)) + draw.choice(["\n", " ", "  ", "\t"]) + draw.choice(shared) + "\n" + line(draw.randrange(0, 25))
             for _ in range(60)]
    texts += [shared[0], shared[0], "", None, " \n\t ", "a" * 500, "a" * 350, "one", line(3000), "one"]
    return texts


@pytest.fixture(scope="session")
def texts_table(spark, words):
    rows = [(i, t, ["x", None, "é", "z"][i % 4], 5, i) for i, t in enumerate(words)]
    # Columns whose names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, source string, spans int, _words int")


@pytest.fixture(scope="session")
def given():
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    return DATA
