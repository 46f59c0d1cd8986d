import math

import numpy as np

from turnlake.llm import topk_search


def by_definition(rows, every, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, list(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in whole)]
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        vector = max(v for i, v in whole if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q and len(v) == len(vector))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


def test_awkward_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=6)]) for i in range(230)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (350, [float("nan")] * 6), (400, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
             (450, [0.0] * 6), (451, [1.0, 2.0]), (500, [1.0, 2.0]), (50, rows[50][1]), (7, [2.0] * 6), (600, []), (601, [])]
    rows += [(i, rows[3][1]) for i in range(700, 720)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as score")
    for sizes in ({}, {"block_rows": 40, "query_rows": 3}):
        got = sorted(tuple(r) for r in topk_search.search(df, **sizes).collect())
        assert got == by_definition(rows, 50, 5)


def test_few_others(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk_search.search(df).collect()) == [(0, 1, 50, -65536), (50, 1, 0, -65536)]
    assert topk_search.search(df.limit(0)).count() == 0
    assert topk_search.search(df.limit(1)).count() == 0


def test_bounds_stop_early_and_stay_exact():
    """A few strong candidates: reading half of each list settles them."""
    draw = np.random.default_rng(1)
    block = np.floor(draw.normal(size=(400, 8)) * 20)
    block[::40] += 300
    queries = np.full((3, 8), 5.0)
    seen = []
    original, topk_search.DEPTHS = topk_search.DEPTHS, (0.2,)
    try:
        row, found, score = topk_search.best_of_block(queries, np.array([-1, -2, -3]), block, np.arange(400), 5)
    finally:
        topk_search.DEPTHS = original
    for q in range(3):
        wanted = sorted(range(400), key=lambda i: (-(block[i] @ queries[q]), i))[:5]
        assert found[row == q].tolist() == wanted
        seen.append(score[row == q].tolist())
    assert seen[0] == sorted(seen[0], reverse=True)


def test_bounds_settle_vectors_without_structure():
    """Before the lists are read to their ends, and with the exact result."""
    draw = np.random.default_rng(6)
    block = np.floor(draw.normal(size=(3000, 64)) * 32)
    queries, own = block[::100], np.arange(3000)[::100]
    original, topk_search.DEPTHS = topk_search.DEPTHS, topk_search.DEPTHS[:-1]
    try:
        row, found, _ = topk_search.best_of_block(queries, own, block, np.arange(3000), 5)
    finally:
        topk_search.DEPTHS = original
    for q, me in enumerate(own):
        wanted = sorted((i for i in range(3000) if i != me), key=lambda i: (-(block[i] @ queries[q]), i))[:5]
        assert found[row == q].tolist() == wanted
