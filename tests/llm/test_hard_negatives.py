import math

import numpy as np
import pytest

from llm_fixtures import given  # noqa: F401
from turnlake.llm import hard_negatives
from turnlake.llm.hard_negatives import mined, search_block, segmentations, summary

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_definition(rows, every=100):
    whole = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        whole.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for anchor in sorted({i for i, _, _ in whole if i % every == 0}):
        v, label = max((v, label) for i, label, v in whole if i == anchor)
        met = [(sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in whole if i != anchor and len(w) == len(v)]
        for p, positive in sorted(((s, i) for s, i, other in met if other == label), key=lambda x: (-x[0], x[1]))[:5]:
            negatives = sorted(((s, i) for s, i, other in met if other != label and 80 * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))
            out += [(anchor, positive, n, i, p, s) for n, (s, i) in enumerate(negatives[:5], 1)]
    return sorted(out)


def test_awkward_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=6)], int(draw.integers(0, 4))) for i in range(700)]
    rows += [(1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 6, 1), (1200, [float("inf")] + [0.0] * 5, 1),
             (None, [1.0] * 6, 1), (1300, [1.0] * 6, None), (1400, [0.0] * 6, 2), (1401, [1.0, 2.0], 2), (1500, [1.0, 2.0], 2), (1502, [1.0, 2.0], 3),
             (100, rows[100][1], rows[100][2]), (200, [2.0] * 6, 0), (1600, [], 1), (1601, [], 1), (1602, [], 2)]
    rows += [(i, rows[3][1], i % 2) for i in range(2001, 2040)]  # ties
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as rank", "3 as q")
    wanted = by_definition(rows)
    assert len(wanted) > 50
    for sizes in ({}, {"block_rows": 90, "anchor_rows": 3}):
        assert sorted(tuple(r) for r in mined(df, **sizes).collect()) == wanted
    assert mined(df.limit(0)).count() == 0
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], SCHEMA)).count() == 0


def test_given_vectors(spark, given):
    df = spark.read.parquet(f"{given}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in mined(df).collect()) == by_definition(rows)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64, 65])
def test_bounds_hold_at_every_refinement(d):
    draw = np.random.default_rng(d)
    a, b = np.floor(draw.normal(size=(20, d)) * 50) + 30, np.floor(draw.normal(size=(40, d)) * 50)
    exact, before = a @ b.T, None
    for cut in segmentations(a.std(axis=0) * b.std(axis=0)):
        (m, s), (n, t) = summary(a, cut), summary(b, cut)
        assert (m @ n.T + s @ t.T >= exact - 1e-6).all() and (m @ n.T - s @ t.T <= exact + 1e-6).all()
        reach = s @ t.T
        assert before is None or (reach <= before + 1e-6).all()
        before = reach


def test_few_pairs_need_their_exact_score(monkeypatch):
    """Smooth vectors: segments tell nearly everything."""
    monkeypatch.setattr(hard_negatives, "SLICE", 128)
    draw = np.random.default_rng(2)
    block = np.floor(np.repeat(draw.normal(size=(4000, 8)) * 100, 8, axis=1) + draw.normal(size=(4000, 64)))
    asks, seen = np.arange(5), {}
    row, found, score = search_block(block[:5], np.arange(5), asks, np.full(5, -np.inf), np.full(5, 400_000.0), block, np.arange(4000), 5, seen)
    for q in range(5):
        wanted = sorted(((-int(block[i] @ block[q]), i) for i in range(4000) if i != q and block[i] @ block[q] <= 400_000))[:5]
        assert [(-s, i) for s, i in zip(score[row == q].tolist(), found[row == q].tolist())] == wanted
    assert seen["scored"] < 0.05 * seen["pairs"]
