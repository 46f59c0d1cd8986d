import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from turnlake.operators import corpus
from turnlake.sources import documents as docs
from turnlake.sources import sessions as src


def test_metadata_defaults_and_malformed(spark, tmp_path):
    good = {"activityType": "Paper Theatre", "boys": 4, "totalStudents": 9, "duration": 12000, "teacherId": "K1",
            "timestamp": "2025-12-23T10:11:12", "photoMetadata": {"teacherName": "N", "latitude": 19.5}}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.json").write_text(json.dumps(good, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text("{}", encoding="utf-8")
    raw = src.read_metadata_files(spark, str(tmp_path))
    got = {r.session_id: r for r in src.load_metadata(raw).collect()}
    assert got["a"].roster == (9, 4, 0) and got["a"].declared_sec == 12.0
    assert str(got["a"].recorded_at) == "2025-12-23 10:11:12" and got["b"].declared_sec is None
    bad = spark.createDataFrame([("x", "{\"teacherId\""), ("y", "[1]"), ("z", "{}")], "session_id string, raw string")
    typed, quarantine = src.load_metadata_leniently(bad)
    assert rows(typed, "session_id") == [("z",)] and rows(quarantine, "session_id") == [("x",), ("y",)]
    with pytest.raises(Exception, match="unreadable metadata for session"):
        src.load_metadata(bad).collect()


def test_invalid_rows_stop_the_job(spark):
    with pytest.raises(Exception, match="must be positive"):
        src.measured_audio(spark.createDataFrame([(1, 0.0)], "session_id long, actual_sec double")).collect()
    with pytest.raises(Exception, match="ends before it starts"):
        corpus.valid_segments(spark.createDataFrame([(2.0, 1.0, "a")], "start double, end double, text string")).collect()
    with pytest.raises(Exception, match="cannot be negative"):
        corpus.checked_roster(spark.createDataFrame([((1, -1, 2),)], "roster struct<total:int,boys:int,girls:int>")).collect()


def test_label_sheet(spark, tmp_path):
    (tmp_path / "S1.md").write_text(
        "# head\n\n| Row | Start | End | Pred | Conf | Truth | Transcript |\n|---|---:|---:|---|---:|---|---|\n"
        "| `S1#0001` | 1.3 | 2.9 | teacher | 0.47 |  | आ |\n| `S1#0003` | 6.8 | 8.0 | Student | 0.47 | TEACHER |  |\n"
        "| `S1#0004` | x | 8.0 | student | 0.47 | teacher | a |\n| `S1#0005` | 1 | 2 | both | 0.4 | teacher | a |\n"
        "| `S1#0006` | 1 | 2 | student | 0.4 | maybe | a |\n", encoding="utf-8")
    got = src.read_label_sheets(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r.row_id, r.predicted, r.truth, r.text) for r in got] == [
        ("S1#0001", "teacher", None, "आ"), ("S1#0003", "student", "teacher", ""), ("S1#0006", "student", None, "a")]


def documents(spark, *sessions, **fields):
    return spark.createDataFrame([(s, "1.0") for s in sessions], "session_id string, schema_version string").withColumns(
        {k: F.lit(v) for k, v in fields.items()})


def timeline(spark, *rows):
    return spark.createDataFrame(rows, "session_id string, seg_no int, t0 double, t1 double, kind string")


def test_documents_survive_writing_and_reading(spark, tmp_path):
    from checks.fixtures import Corpus
    a = Corpus(spark, "/root/testdata/sf0.001").analysis
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    docs.write_documents(a.documents, a.published_timeline, out)
    docs.write_documents(a.documents.filter("session_id = 3"), a.published_timeline.filter("session_id = 3"), out)
    docs.write_index(a.recordings.filter("session_id <> 5"), index)
    back, lines = docs.read_documents(spark, out, index)
    assert back.count() == a.recordings.count() - 1
    assert lines.count() == a.labelled.filter("session_id <> 5").count()
    row = back.filter("session_id = '3'").first()
    sums = a.labelled.filter("session_id = 3").agg(F.sum(F.col("end") - F.col("start"))).first()[0]
    assert len(row.metrics) == 7 and sum(row.totals_sec.values()) == pytest.approx(sums, abs=0.05)
    text = json.dumps([r.asDict(recursive=True) for r in back.collect()], ensure_ascii=False, default=str)
    assert "A. Name" not in text and "somewhere" not in text
    assert set(a.documents.columns) >= {"schema_version", "teacher", "audio", "models", "insight", "flags"}


def test_ids_are_text_and_long_sessions_whole(spark, tmp_path):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    long = spark.range(12_000).selectExpr("'0012' as session_id", "cast(id as int) as seg_no", "cast(id as double) as t0",
                                          "id + 1.0D as t1", "'dead' as kind")
    docs.write_documents(documents(spark, "0012", "7"), long.unionByName(timeline(spark, ("7", 0, 0.0, 1.0, "dead"))), out)
    docs.write_index(documents(spark, "0012", "index"), index)
    back, lines = docs.read_documents(spark, out, index)
    assert rows(back, "session_id") == [("0012",)]
    assert lines.agg(F.count("*"), F.countDistinct("seg_no"), F.max("t1")).first() == (12_000, 12_000, 12_000.0)


def test_absent_index_reads_as_empty(spark, tmp_path):
    out = str(tmp_path / "out")
    docs.write_documents(documents(spark, "a"), timeline(spark, ("a", 0, 0.0, 1.0, "dead")), out)
    back, lines = docs.read_documents(spark, out, str(tmp_path / "nothing"))
    assert back.count() == 0 and lines.count() == 0


def test_the_latest_readable_run_counts(spark, tmp_path):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    docs.write_index(documents(spark, "a", "b", "c"), index)
    docs.write_documents(documents(spark, "a", "b", activity="old"), timeline(spark, ("a", 0, 0.0, 1.0, "dead"), ("b", 0, 0.0, 1.0, "dead")), out)
    docs.write_documents(documents(spark, "a", activity="new"), timeline(spark, ("a", 0, 0.0, 2.0, "dead"), ("a", 1, 2.0, 3.0, "dead")), out)
    (tmp_path / "out" / "documents" / "run=r99999999999999999999").mkdir()
    (tmp_path / "out" / "documents" / "run=r99999999999999999999" / "x.json").write_text('{"session_id": "b", "schema_ver')
    back, lines = docs.read_documents(spark, out, index)
    assert rows(back, "session_id", "activity") == [("a", "new"), ("b", "old")]
    assert rows(lines, "session_id", "t1") == [("a", 2.0), ("a", 3.0), ("b", 1.0)]


def test_sparse_segment_numbers_survive(spark, make):
    heads = docs.transcript_heads(spark.createDataFrame(
        [(0, "hi", 0.5, "b", "m", 9.0)], "session_id long, language string, language_prob double, backend string, model string, audio_sec double"))
    segs = make.segments([(0, 1, "a"), (1, 2, "b")]).withColumn("seg_ix", F.col("seg_ix") * 2 + 5)
    assert rows(docs.transcript_rows(heads, docs.transcript_lines(segs)), "seg_ix", "text", "language") == [(7, "a", "hi"), (9, "b", "hi")]


def test_finished_work_is_skipped_by_content(spark):
    work = spark.createDataFrame([("a.mp3", "x"), ("copy.mp3", "x"), ("b.mp3", "y"), ("c.mp3", "z"), ("d.mp3", "w")],
                                 "name string, content string").withColumn(
        "key", docs.content_key(F.col("content"), F.lit("p"), F.lit(None)))
    key = {r.content: r.key for r in work.collect()}
    done = spark.createDataFrame([(key["x"], '{"turns": []}'), (key["y"], '{"turns": [{'), (key["z"], '{"other": 1}')],
                                 "key string, value string")
    assert rows(docs.pending(work, done), "name") == [("b.mp3",), ("c.mp3",), ("d.mp3",)]


def test_head_counts_as_text_and_as_decimals(spark):
    raw = spark.createDataFrame([("a", '{"boys": "3", "girls": 3.0, "totalStudents": 6}'), ("b", '{"boys": "", "girls": null}'),
                                 ("c", '{"boys": -1}'), ("d", '{"boys": "three"}')], "session_id string, raw string")
    good, bad = src.load_metadata_leniently(raw)
    assert {r.session_id: tuple(r.roster) for r in good.collect()} == {"a": (6, 3, 3), "b": (0, 0, 0)}
    assert rows(bad, "session_id") == [("c",), ("d",)]
    with pytest.raises(Exception, match="unreadable metadata for session c"):
        src.load_metadata(raw.filter("session_id = 'c'")).collect()


def test_dates_without_leading_zeros(spark):
    df = spark.createDataFrame([("2025-1-2 9:05:03",), ("2025-01-02T09:05:03",), ("2/1/2025",)], "t string")
    got = [r[0] for r in df.select(corpus.parse_timestamp(F.col("t"))).collect()]
    assert [str(x) for x in got] == ["2025-01-02 09:05:03", "2025-01-02 09:05:03", "None"]


def test_a_second_run_computes_what_is_new(spark, tmp_path):
    from turnlake.plans.incremental import compact, entries, run_pending
    store, seen = str(tmp_path / "store"), []

    def compute(todo):
        seen.append(sorted(r.key for r in todo.collect()))
        return todo.select("key", F.lit('{"turns": []}').alias("value"))

    work = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert rows(run_pending(work("a", "b", "b"), store, compute, "r1"), "key", "run") == [("a", "r1"), ("b", "r1"), ("b", "r1")]
    # A damaged entry of a finished run, and a run that stopped before it was listed.
    damaged = spark.createDataFrame([("c", '{"turns": [')], "key string, value string")
    run_pending(work("c"), store, lambda todo: damaged, "r11")
    damaged.selectExpr("key", "'{\"turns\": []}' as value", "true as readable", "'2e' as bucket").write.partitionBy("bucket").parquet(f"{store}/entries/run=r12")
    assert rows(run_pending(work("b", "c"), store, compute, "r2"), "key", "run") == [("b", "r1"), ("c", "r2")]
    assert seen == [["a", "b"], ["c"]] and entries(spark, store).count() == 4
    with pytest.raises(ValueError):
        run_pending(work("z"), store, compute, "r2")
    # The stopped run can be made again under its name; a new base holds each readable entry once.
    assert rows(run_pending(work("d"), store, compute, "r12"), "key", "run") == [("d", "r12")]
    compact(spark, store, "r3")
    assert rows(entries(spark, store), "key", "run", "readable") == [(k, "r3", True) for k in "abcd"]
    assert rows(run_pending(work("a", "e"), store, compute, "r4"), "key", "run") == [("a", "r3"), ("e", "r4")]
    assert seen[-1] == ["e"]


def test_a_store_is_read_by_bucket(spark, tmp_path):
    from turnlake.plans.incremental import run_pending
    store = str(tmp_path / "store")
    work = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    compute = lambda todo: todo.select("key", F.lit('{"segments": []}').alias("value"))
    run_pending(work, store, compute, "r1")
    found = run_pending(work.limit(1), store, compute, "r2")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert any("bucket" in filters for filters in scans) and "from_json" not in plan


def test_a_stopped_run_does_not_count(spark, tmp_path, monkeypatch):
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    docs.write_index(documents(spark, "a", "b"), index)
    lines = timeline(spark, ("a", 0, 0.0, 1.0, "dead"), ("b", 0, 0.0, 1.0, "dead"))
    docs.write_documents(documents(spark, "a", "b", activity="old"), lines, out, "r1")
    broken = lines.withColumn("start", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        docs.write_documents(documents(spark, "a", activity="new"), broken, out, "r2")
    back, rows_back = docs.read_documents(spark, out, index)
    assert rows(back, "session_id", "activity") == [("a", "old"), ("b", "old")] and rows_back.count() == 2
    # Written again to its end, it counts; once finished, it stays as it is.
    docs.write_documents(documents(spark, "a", activity="new"), lines.filter("session_id = 'a'"), out, "r2")
    back, rows_back = docs.read_documents(spark, out, index)
    assert rows(back, "session_id", "activity") == [("a", "new"), ("b", "old")] and rows_back.count() == 2
    with pytest.raises(ValueError):
        docs.write_documents(documents(spark, "a"), lines, out, "r1")


def test_scores_survive_export(spark, tmp_path):
    scores = spark.createDataFrame([("x", 0.25, None), ("y", None, 3)], "backend string, wer double, failed long")
    docs.write_rows(scores, str(tmp_path / "s"))
    assert rows(docs.read_rows(spark, str(tmp_path / "s"), scores.schema), *scores.columns) == rows(scores, *scores.columns)
