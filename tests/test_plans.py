"""Plan shape checks for every registered query with an oracle: no Python
UDF, no cartesian product or nested-loop join, and pruned parquet scans."""

import re

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E

# Their results are small tables of fitted numbers; tests/test_oracle.py runs them.
FITS = {"oof_every_key_once", "grid_search_best", "permutation_refit", "selected_f_test", "model_roundtrip_equal", "svm_optimality", "elastic_net_optimality"}

SQL = E.oracle_sql()
QUERIES = E.queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", sorted(set(SQL) - FITS))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    # Every scan reads a pruned column list (the widest driver table has 11).
    for cols in re.findall(r"FileScan parquet \[([^\]]*)\]", plan):
        assert 1 <= len(cols.split(",")) <= 11


def _formatted(spark, df) -> str:
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_reach_the_scan(spark):
    plan = _formatted(spark, QUERIES["filter_and"](spark, SF_SMALL))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert pushed and "EqualTo(l_returnflag,R)" in pushed[0] and "GreaterThanOrEqual(l_quantity,30.0)" in pushed[0]
    plan = _formatted(spark, QUERIES["select_list"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    df = QUERIES["select_list"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FileScan parquet \[o_orderkey#\d+L,o_custkey#\d+L,o_totalprice#\d+\]", plan)
