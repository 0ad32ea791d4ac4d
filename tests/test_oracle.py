"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from flowlens.plans import QUERIES, TWINS
from tests import compare

# Batch queries stay in the JVM and have no product joins.
FORBIDDEN = (
    "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def con(small_dir):
    return compare.connect(small_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_twin(spark, con, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns, rows = compare.run_spark(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in FORBIDDEN)
    twin_columns, twin_rows = compare.run_twin(con, TWINS[name])
    assert columns == twin_columns
    assert rows == twin_rows
