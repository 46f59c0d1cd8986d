"""Every registered query against its DuckDB check, and split mode against plain mode."""

import pytest

from checks.compare import check, duck
from checks.fixtures import Corpus
from checks.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_check(spark, con, name):
    assert check(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name)) == ""


def test_split_mode_changes_nothing(spark):
    plain = Corpus(spark, FOLDER)
    assert not plain.split
    spark.conf.set("turnlake.scan.maxRowsPerTask", "3")
    try:
        split = Corpus(spark, FOLDER)
        assert split.split
        for name in ("timeline", "labelled", "discourse"):
            a, b = getattr(plain.analysis, name), getattr(split.analysis, name)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
    finally:
        spark.conf.unset("turnlake.scan.maxRowsPerTask")


def test_mixed_paths_agree_with_plain_ones(spark):
    c = Corpus(spark, FOLDER)
    mixed, plain = c.analyse(loudness_path=True).values, c.analysis.values
    shared = ["session_id", "verdict", "teacher_sec", "m3", "m4", "questions"]
    with_turns = "session_id % 17 <> 0"
    assert mixed.count() == plain.count()
    assert mixed.filter(with_turns).select(shared).exceptAll(plain.filter(with_turns).select(shared)).isEmpty()
    assert mixed.filter(f"not ({with_turns})").filter("teacher_sec > 0").count() > 0
