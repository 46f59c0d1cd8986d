import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from turnlake.ranges import overlap_join
from turnlake.scan import (Ordered, Running, following, following_min, last_value, needs_split, previous, running_max,
                           running_sum)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    # Key 0 holds nearly all rows, so several blocks belong to it alone.
    data = [(0 if i % 10 else i % 7, i, rng.choice([None, rng.randint(0, 50)]), rng.random()) for i in range(400)]
    return spark.createDataFrame(data, "k int, ix int, v int, w double")


def runs():
    return {
        "a": running_sum(F.col("v")), "b": running_sum(F.lit(1)), "c": running_max(F.col("w")),
        "d": following_min(F.col("w")), "e": last_value(F.col("v"), inclusive=True), "f": last_value(F.col("v")),
        "g": previous(F.col("v")), "h": following(F.col("v")), "i": running_sum(F.col("v"), inclusive=False),
        "j": Running("sum", F.lit(1), backward=True, inclusive=True),
    }


def brute(table):
    out = []
    data = sorted(tuple(r) for r in table.collect())
    for k, ix, v, w in data:
        group = [r for r in data if r[0] == k]
        before, after = [r for r in group if r[1] < ix], [r for r in group if r[1] > ix]
        upto = before + [(k, ix, v, w)]
        vs = lambda rs: [r[2] for r in rs if r[2] is not None]
        out.append((k, ix, sum(vs(upto)) if vs(upto) else None, len(upto), max((r[3] for r in before), default=None),
                    min((r[3] for r in after), default=None), (vs(upto) or [None])[-1], (vs(before) or [None])[-1],
                    before[-1][2] if before else None, after[0][2] if after else None,
                    sum(vs(before)) if vs(before) else None, len(after) + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [False, True])
def test_running_columns_match_their_definition(table, split):
    got = Ordered(table, ["k"], ["ix"], split).with_columns(**runs()).df.select("k", "ix", *runs())
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(table)


def test_split_without_a_key_ranks_the_whole_table(table):
    got = Ordered(table, [], ["ix"], True).with_columns(n=running_sum(F.lit(1))).df
    assert [r.n for r in got.orderBy("ix").collect()] == list(range(1, 401))


def test_split_is_chosen_by_the_largest_key(spark, table):
    assert not needs_split(table, ["k"])
    spark.conf.set("turnlake.scan.maxRowsPerTask", "50")
    try:
        assert needs_split(table, ["k"])
    finally:
        spark.conf.unset("turnlake.scan.maxRowsPerTask")


def test_blocks_follow_the_rows(spark):
    """One key with all rows: no block holds more than a few times the limit."""
    spark.conf.set("turnlake.scan.maxRowsPerTask", "100")
    try:
        rows_ = spark.range(3000).selectExpr("1 as k", "id as ix")
        blocks = Ordered(rows_, ["k"], ["ix"], True)._df.groupBy("_block").count()
        sizes = [r["count"] for r in blocks.collect()]
    finally:
        spark.conf.unset("turnlake.scan.maxRowsPerTask")
    assert sum(sizes) == 3000 and len(sizes) >= 20 and max(sizes) <= 300


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.randint(0, 1), i, a := rng.randint(0, 400) / 4, a + rng.choice([0, 1, 30, 170])) for i in range(n)]
    left, right = spans(80), spans(80)
    l = spark.createDataFrame(left, "s int, i int, a double, b double")
    r = spark.createDataFrame(right, "s int, j int, c double, d double")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])
    for width in (7.0, 60.0, 1000.0):
        assert rows(overlap_join(l, r, ["s"], ("a", "b"), ("c", "d"), width), "i", "j") == sorted(want, key=lambda t: [(False, str(v)) for v in t])
    outer = overlap_join(l, r, ["s"], ("a", "b"), ("c", "d"), 7.0, "left").groupBy("i").agg(F.count("j").alias("n"))
    assert {(x.i, x.n) for x in outer.collect()} == {(x[1], sum(p[0] == x[1] for p in want)) for x in left}
