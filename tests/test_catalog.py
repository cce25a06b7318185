import pytest

import __spark_entry__ as entry_points
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in CHECKS:
        assert difference(frame, FOLDER, CHECKS[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 8
