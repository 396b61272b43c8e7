"""Estimates of sizes do not grow from cut to cut until the driver plans with numbers of a million digits."""

import pytest

pytest.importorskip("tesserine.llm.entries")

from tesserine.llm import graph
from tesserine.llm.common import cut


def test_sizes_stay_short_over_joins_of_a_frame_with_itself(spark):
    step = spark.range(64).selectExpr("id as x", "greatest(id - 1, 0) as p")
    for _ in range(6):
        step = cut(graph._jump(step)).selectExpr("x", "q as p")
        plan = step._jdf.queryExecution().analyzed().children().head()
        assert "E+" not in plan.stats().simpleString()
    assert {r.p for r in step.collect()} == {0}
