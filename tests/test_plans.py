import os

import pytest

from checks.fixtures import Corpus

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_plans_do_not_hold_the_plans_of_shared_tables(spark):
    """A table that several branches read is a table to them: its own plan would stand in theirs once for each reading."""
    analysis = Corpus(spark, FOLDER).analyse(loudness_path=True)
    for table in (analysis.labelled, analysis.discourse, analysis.values, analysis.metrics):
        assert len(table._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    first = analysis.values
    analysis.release()
    again = analysis.values
    assert again is not first and sorted(again.collect()) == sorted(first.collect())


def test_bars_do_not_read_texts(spark):
    """Bars show times, kinds and roles; the texts of the published timeline are not collected for them."""
    from checks.queries import QUERIES
    plan = QUERIES["timeline_bars"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", ["metric_teacher_stretch", "window_bias"])
def test_acoustic_results_look_for_no_question(spark, name):
    """They rest on the timeline: questions, answers and pauses are not in them, so no text is searched for them."""
    from checks import queries
    queries.forget_corpora()
    queries.QUERIES[name](spark, FOLDER).collect()
    corpus = queries.corpus_of(spark, FOLDER)
    assert not any("discourse" in vars(a) for a in corpus._analyses)
    whole = corpus.analysis.metrics.filter("key < 'M5'")
    assert sorted(map(str, corpus.analysis.acoustic_metrics.collect())) == sorted(map(str, whole.collect()))
