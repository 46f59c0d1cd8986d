import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from turnlake.llm import queries


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, copies, near copies, toxic texts and a shared passage of 60 words."""
    import random
    draw = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n)) + "."
    passage = say(60)
    rows = []
    for i in range(260):
        text = say(90)
        if i % 6 == 0:
            text += draw.choice([" rotter", " Swine!", " gitface"]) + " " + say(5)
        rows.append([i, text])
    rows[101][1] = rows[100][1]
    rows[103][1] = rows[100][1].replace(rows[100][1].split()[40], "changed")
    for i in (205, 207, 209):
        rows[i][1] = say(40) + " " + passage + " " + say(30)
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows] + [(260, None, None, None, None), (261, "", "en", "s0", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(map(tuple, rows)), passage


def test_stage_by_stage(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, path)
    assert clean.columns == list(cp.COLUMNS)
    left = {r.doc_id for r in clean.collect()}
    assert left == {i for i in texts if i % 6} | {260, 261}
    single = cp.drop_near_duplicates(spark, clean, path)
    left -= {101, 103, 261}
    assert {r.doc_id for r in single.collect()} == left
    cut = cp.cut_repeats(spark, single, path)
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == left and cut.columns == list(cp.COLUMNS)
    assert passage in got[205].text and passage not in got[207].text and passage not in got[209].text
    assert got[1].text == texts[1] and all(r.n_chars == len(r.text) for r in got.values())
    mix = cp.mix_sources(spark, cut, path)
    assert mix.columns == list(cp.COLUMNS)
    times = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert set(times) <= left and max(times.values()) <= 2
    assert sum(times.values()) == pytest.approx(1.5 * len(left - {260}), rel=0.05)
    ids = cp.encode(spark, mix, path)
    assert ids.count() == mix.count() and ids.filter("n_tokens = 0").count() == 0


def test_whole_run(spark, folder):
    rows = cp.run(spark, folder[0])
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 200


def test_registered(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and "op1_suffix_array" in names and "ordered_metrics" in names
    assert set(entry.oracle_sql()) <= set(names)
