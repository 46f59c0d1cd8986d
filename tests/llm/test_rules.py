import re

import pytest

from llm_fixtures import texts_table, words  # noqa: F401
from turnlake.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_figures(texts_table, words):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality_rules.cleaned(texts_table).collect() if r.n_words < 1000}
    wanted = {i: figures(t) for i, t in enumerate(words)}
    assert got == {i: x for i, x in wanted.items() if x[0] < 1000}


GOOD = "This is a sentence of some eight plain words.\n"


@pytest.mark.parametrize("line, rule", [
    ("Home | News | Sport | About |", "navigation"), ("All rights reserved by nobody here.", "boilerplate"),
    ("no end to this line", "punctuation"), ("GET IT NOW! BUY!", "punctuation"), ("so### many$$$ signs***.", "punctuation"),
    ("A line as it should be.", None), ("", None), ("   ", None)])
def test_each_rule(spark, line, rule):
    df = spark.createDataFrame([(1, line)], "doc_id long, text string")
    got = df.select(quality_rules.line_facts(df["text"], quality_rules.LineRules()).alias("x")).first().x
    assert got.failed == rule


def test_verdicts(spark):
    distinct = "\n".join(f"Sentence number {i} says thing {i * 7} and word{i}." for i in range(20))
    junk = "\n".join(f"Go{i}a | To{i}b | At{i}c |" for i in range(60))
    rows = spark.createDataFrame([(1, distinct), (2, junk), (3, distinct + "\n" + junk), (4, GOOD), (5, None), (6, GOOD * 10), (1, distinct)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.base_failed, r.kept, r.clean_text) for r in quality_rules.cleaned(rows).collect())
    assert [x[:3] for x in got] == [(1, False, True), (1, False, True), (2, False, False), (3, False, False), (4, True, False),
                                    (5, True, False), (6, True, False)]
    assert got[0][3] == distinct
    assert quality_rules.cleaned(rows.limit(0)).count() == 0


def test_plan_has_no_python(texts_table):
    plan = quality_rules.cleaned(texts_table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
