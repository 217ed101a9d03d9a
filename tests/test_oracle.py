"""Every registered query with an oracle SQL against DuckDB on the smallest
test tables (the driver runs the same comparison at sf0.01), and the
rows-only queries for their invariants; tests/test_pipeline.py and
tests/test_batch.py check the parts of the model loops on small data."""

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()
MODEL_LOOPS = ["nested_cv", "oof_probabilities", "svm_balanced", "grid_search", "selected_features", "best_parameters"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(SQL[name]).df()
    assert compare(got, want) is None


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert set(df.columns) >= {"flag", "p", "p_fdr", "chi2", "dof"}


@pytest.mark.parametrize("name", MODEL_LOOPS)
def test_model_loops(spark, name):
    assert len(QUERIES[name](spark, SF_SMALL).toPandas()) > 0


def test_rows_only_queries(spark):
    pl = QUERIES["permute_labels"](spark, SF_SMALL).toPandas()
    assert pl.o_orderkey.is_unique and pl.label.sum() == pl.permuted.sum()
    pt = QUERIES["permutation_test"](spark, SF_SMALL).first()
    assert 0 < pt.p_value <= 1
    ic = QUERIES["impute_chained"](spark, SF_SMALL).toPandas()
    assert ic.notna().all().all()
    en = QUERIES["select_elastic_net"](spark, SF_SMALL).toPandas()
    assert len(en) == 64
    mr = QUERIES["model_roundtrip"](spark, SF_SMALL).toPandas()
    assert mr.vec_id.is_unique and mr.prob.between(0, 1).all()
    lo = QUERIES["logit_odds_ratios"](spark, SF_SMALL).toPandas()
    assert (lo.ci_lo <= lo.odds_ratio).all() and (lo.odds_ratio <= lo.ci_hi).all()
