"""Listings meet their detail pages without a broadcast of the pages."""

import pytest

from postforge.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["source_icims", "source_successfactors"])
def test_detail_pages_are_not_sent_to_the_driver(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
