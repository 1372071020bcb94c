"""Queries without SQL run on the smallest tables and give rows."""

import os

import pytest

from factorloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["convergence_history", "timing_by_iteration", "greedy_search_cross_validation", "kernelized_nested_cross_validation", "kmeans_fit", "noise_ratio_sweep"])
def test_query_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
