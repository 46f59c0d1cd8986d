import re

import pytest

from turnlake.llm import mixing


def shared_out(sizes, weights, total, times=2):
    """The rule as it is told: deal by weight, stop at the cap, deal the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while left > 1e-9 and open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= times * sizes[s]:
                left += target[s] - times * sizes[s]
                target[s] = float(times * sizes[s])
                open_.discard(s)
    return target


def corpus(spark):
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else ["b", "a", None, "é", "Z", "empty"][i % 6]
        text = None if source == "empty" else " ".join(["w"] * (i * 37 % 301))
        rows.append((i, source, text, 1.0, 2))
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, target double, size int")


def test_targets_sizes_and_takes(spark):
    rows, df = corpus(spark)
    sizes = {}
    for _, source, text, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    wanted = shared_out(sizes, weights, 1.5 * sum(sizes.values()))
    taken, source_of = {}, {r[0]: r[1] for r in rows}
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.size == len((rows[r.doc_id][2] or "").split()) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 4 * 64
    again = {(r.doc_id, r.taken) for r in mixing.mixed(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_schedule_mixes_evenly(spark):
    _, df = corpus(spark)
    plan = mixing.targets(mixing.sized(df)).cache()
    slots = sorted((r.slot, r.source_ix) for r in mixing.schedule(plan).collect())
    share = {r.source_ix: r.target / r.total for r in plan.collect()}
    for begin in range(0, len(slots) - 100, 100):
        part = [s for _, s in slots[begin:begin + 100]]
        for s, x in share.items():
            assert abs(part.count(s) - 100 * x) <= 4


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, None), (None, None, ""), (2, "a", " ")], schema)).collect()
    assert len(got) == 3 and all(r.taken == 0 and r.target == 0 for r in got)
    twice = mixing.mixed(spark.createDataFrame([(1, "a", "x y z")] * 2, schema)).collect()
    assert [(r.size, r.source_size, r.target) for r in twice] == [(3, 6, 9.0)] * 2 and sum(r.taken for r in twice) in (6, 12)


def test_words(spark):
    text = "a b  c\x0bd\x1ce\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mixing.words_of(df["t"])).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text))
