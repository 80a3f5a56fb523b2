import os

import pytest

import oracle_check
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_resampling_hashes_and_does_not_sort_raw_ticks(spark):
    for name in ("a1_resample_daily", "a1_resample_intraday"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["a1_resample_daily", "j1_aligned_panel", "w25_coverage_merge", "k2_slate_winner", "p10_portfolio_rules"])
def test_query_equals_its_statement(spark, name):
    assert oracle_check.compare(queries()[name](spark, SF), oracle_check.connect(SF), oracle_sql()[name]) == []
