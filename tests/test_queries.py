"""Every query with a SQL answer, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from compare import compare
from telemetra.plans.queries import GROUPS, TRAIN_GROUPS

# column groups of the full vector, and the streams that test_streaming runs
COVERED = (set(GROUPS) - {"feature_vector"}) | (set(TRAIN_GROUPS) - {"train_rolling", "train_streak"})
NAMES = sorted(set(entry.oracle_sql()) - COVERED)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_answer_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_product_joins(spark, sf):
    """Scalars come in as subqueries; no plan pairs all rows of two inputs."""
    streams = {"stream_features", "stream_live", "gbt_scores", "tree_contributions", *COVERED}
    for name, fn in entry.queries().items():
        if name not in streams:
            plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
