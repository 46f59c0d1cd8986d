import pytest

from turnlake.llm.components import components


def test_a_long_path_is_one_component_and_too_few_rounds_stop_the_job(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    with pytest.raises(RuntimeError, match="not settled"):
        components(links, rounds=1)
