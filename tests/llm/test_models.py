import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from turnlake.llm import labelled, quality_model, toxicity

WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("tan", "rel", "sor", "") for c in ("d", "ning", "s", "a")]


def corpus(spark, n=700):
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text = ". ".join(" ".join(draw.choice(WORDS) for _ in range(draw.randrange(5, 12))).capitalize() for _ in range(6)) + "."
        toxic, poor = i % 7 == 0, i % 5 == 1
        if toxic:
            ws = text.split()
            ws.insert(draw.randrange(len(ws)), draw.choice(["rotter,", "SWINE", "gitface"]))
            text = " ".join(ws)
        if poor:
            text = " ".join(w + draw.choice(["###", "$$$", " |"]) for w in text.split())
        docs.append((i, text, "src", 1.0))
        if i % 2 == 0 or i > n // 2:
            labels.append((i, int(not poor), int(toxic)))
    docs += [(n, None, None, 1.0), (n + 1, "", None, 1.0), (None, "bad rotter", None, 1.0), (3, docs[3][1], "src", 1.0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, score double"),
            spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), docs, labels)


@pytest.mark.parametrize("module, label, folds, fold, cut", [(toxicity, "toxic", 3, 1, 0.7), (quality_model, "quality", 5, 0, 0.3)])
def test_held_out_rows_are_told(spark, module, label, folds, fold, cut):
    docs, labels, rows, given = corpus(spark)
    got = module.scored(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {d: (t if label == "toxic" else q) for d, q, t in given}
    wrong, n = 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        if r.held_out and r.doc_id in truth:
            n += 1
            wrong += r.predicted != truth[r.doc_id]
    assert n > 50 and wrong <= 0.02 * n


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_little_to_learn_from(spark, module):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in module.scored(docs, none).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert [r.score for r in module.scored(docs, ones).collect()] == [1.0] * 3
    both = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert module.scored(docs.limit(0), both).count() == 0


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels, *_ = corpus(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = sorted((str(r.doc_id), r.score) for r in toxicity.scored(docs, labels).collect())
    b = sorted((str(r.doc_id), r.score) for r in toxicity.scored(docs, flipped).collect())
    assert a == b


def test_block_max_search_is_exact():
    draw = np.random.default_rng(2)
    lists = [(np.sort(draw.choice(60, draw.integers(0, 9), replace=False)), None) for _ in range(500)]
    lists = [(t, draw.integers(1, 4, len(t)).astype(float)) for t, _ in lists]
    rarity = draw.uniform(0.5, 5, 60)
    index = toxicity.BlockMaxIndex(list(range(500)), draw.integers(0, 2, 500).astype(float), lists, rarity, 16)
    dense = np.zeros((500, 60))
    for row, i in enumerate(index.ids):
        dense[row, lists[i][0]] = index.vector(*lists[i])
    for t, n in lists[:80]:
        query = np.zeros(60)
        query[t] = index.vector(t, n)
        score = dense @ query
        near, similarity = index.nearest(t, n, 7)
        wanted = [i for i in np.argsort(-score.round(12), kind="stable")[:7] if score[i] > 0]
        assert np.allclose(similarity, np.sort(score)[::-1][:len(similarity)])
        assert len(near) == len(wanted)


def test_terms_do_not_depend_on_the_texts_beside():
    texts = ["bad rotter", "rotten apples", "", None, "x", "y", " led", "été", "à", "end"]
    beginnings = toxicity.Settings().beginnings
    for one in (lambda ts: [(int(r), int(t)) for row, term in toxicity.terms(pa.array(ts, pa.string()), beginnings) for r, t in zip(row, term)],
                lambda ts: list(zip(*(x.tolist() for x in quality_model.indicators(pa.array(ts, pa.string())))))):
        alone = [(i, t) for i, text in enumerate(texts) for _, t in one([text])]
        assert sorted(one(texts)) == sorted(alone)


def test_scores_are_votes_of_the_plain_nearest_neighbours(spark):
    """Counts, rarities, cosines, neighbours and votes by their definitions, over the terms the operator chose."""
    docs, labels, rows, _ = corpus(spark, 400)
    settings = toxicity.Settings(neighbours=5, block=8)
    sample = labelled.sample(docs, labels, "toxic", settings.folds, settings.fold, settings.per_class)
    chosen = toxicity.chosen_terms(sample, settings)
    _, judge = toxicity.fit(docs, labels, settings)
    assert len(chosen) and judge.background in [b * 5 for b in settings.backgrounds]

    def counts(text):
        found = [t for _, ts in toxicity.terms(pa.array([text], pa.string()), settings.beginnings) for t in ts]
        return np.array([found.count(t) for t in chosen], dtype=float)

    table = {text: counts(text) for text in {r[1] for r in rows}}
    rarity = np.log((1 + len(rows)) / (1 + sum((table[r[1]] > 0).astype(float) for r in rows))) + 1

    def vector(text):
        n = table[text]
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0) * rarity
        return v / max(np.linalg.norm(v), 1e-12)

    examples = {r.doc_id: (r.text, r.label) for r in sample.collect()}
    ids = judge.index.ids
    assert sorted(ids) == sorted(examples)
    dense = np.array([vector(examples[i][0]) for i in ids])
    label = np.array([examples[i][1] for i in ids], dtype=float)
    expected = {}
    for doc, text, *_ in rows:
        similarity = dense @ vector(text)
        near = [i for i in np.argsort(-similarity.round(9), kind="stable")[:5] if similarity[i] > 0]
        weight = similarity[near] / (1 - np.minimum(similarity[near], 0.99))
        vote = ((weight * label[near]).sum() + judge.background * judge.otherwise) / (weight.sum() + judge.background)
        expected.setdefault(doc, 1 / (1 + np.exp(-(judge.a * (vote - 0.5) + judge.b))) if near else judge.otherwise)
    for r in toxicity.scored(docs, labels, settings).collect():
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-9), r.doc_id


def test_background_is_the_one_that_fits_left_out_votes():
    """Neighbours that are right ask for little background, far ones that are wrong for much."""
    index = toxicity.BlockMaxIndex(list(range(20)), np.arange(20) % 2.0, [(np.array([i % 2]), np.array([1.0])) for i in range(20)], np.ones(2), 4)
    settings = toxicity.Settings(neighbours=3)
    number = {kind: np.flatnonzero(index.label == kind)[:3] for kind in (0.0, 1.0)}
    label = np.arange(40) % 2.0
    near = [(number[y], np.full(3, 0.9)) for y in label]
    far = [(number[1 - y], np.full(3, 0.05)) if i < 12 else (number[y], np.full(3, 0.9)) for i, y in enumerate(label)]
    right = toxicity.likeliest(index, settings, 0.5, near, label, np.ones(40))
    mixed = toxicity.likeliest(index, settings, 0.5, far, label, np.ones(40))
    assert right.background < mixed.background
    none = toxicity.likeliest(index, settings, 0.5, [], np.zeros(0), np.zeros(0))
    assert none.background == settings.backgrounds[-1] * 3


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(60, 4)), None
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.3 * draw.normal(size=60) > 0).astype(float)
    col, starts = np.tile(np.arange(4), 60), np.arange(0, 241, 4)
    cost = np.full(60, 0.7)
    weight = quality_model.dual_descent(col, x.reshape(-1), starts, y, cost, 500, columns=4)
    sign = 2 * y - 1

    def loss(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1]))).sum()
    best = loss(weight)
    for _ in range(300):
        assert loss(weight + 0.05 * draw.normal(size=5)) >= best - 1e-3
