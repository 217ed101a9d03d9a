"""Model operators against closed forms and cross-checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import models as M
from cohortlab.operators import stattests as ST
from cohortlab.operators.impute import impute_chained


def test_logit_two_by_two(spark):
    a, b, c, d = 30, 20, 15, 35  # x=1,y=1 / x=1,y=0 / x=0,y=1 / x=0,y=0
    rows = [(1, 1)] * a + [(1, 0)] * b + [(0, 1)] * c + [(0, 0)] * d
    df = spark.createDataFrame(rows, "x int, y int")
    t, st_ = M.logit_fit(df, "y", ["x"])
    got = {r.term: r for r in t.collect()}
    assert got["x"].coef == pytest.approx(math.log(a * d / (b * c)), abs=1e-8)
    assert got["x"].se == pytest.approx(math.sqrt(1 / a + 1 / b + 1 / c + 1 / d), abs=1e-8)
    assert got["Intercept"].coef == pytest.approx(math.log(c / d), abs=1e-8)
    llf = a * math.log(a / (a + b)) + b * math.log(b / (a + b)) + c * math.log(c / (c + d)) + d * math.log(d / (c + d))
    assert st_["llf"] == pytest.approx(llf, abs=1e-6)


def test_t_squared_equals_f(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x)) for g in (0, 1) for x in rng.normal(g * 0.3, 1, size=80 + 20 * g)]
    df = spark.createDataFrame(rows, "g int, x double")
    t = ST.ttest(df, ["x"], "g", 1, 0).first()
    f = ST.anova_f(df, ["x"], "g").first()
    assert t.t ** 2 == pytest.approx(f.F)
    assert t.p == pytest.approx(f.p, abs=1e-10)


def test_chi2_against_ml_stat(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 2)), int(rng.integers(0, 4))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, y int")
    mine = {r.column: r for r in ST.chi2_independence(df, ["a", "b"], "y").collect()}
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df.withColumn("y", F.col("y").cast("double")))
    ref = ChiSquareTest.test(vec, "f", "y").first()
    assert mine["a"].chi2 == pytest.approx(ref.statistics[0])
    assert mine["b"].chi2 == pytest.approx(ref.statistics[1])
    assert mine["a"].dof == ref.degreesOfFreedom[0]
    assert mine["a"].p == pytest.approx(ref.pValues[0], abs=1e-9)


def test_chained_imputation_keeps_observed(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    rows = []
    for i, v in enumerate(x):
        a = float(v)
        b = float(2 * v + rng.normal(scale=0.1))
        c = float(-v + rng.normal(scale=0.1))
        rows.append((i, a if i % 7 else None, b if i % 5 else None, c))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    out = impute_chained(df, ["a", "b", "c"], rounds=2).toPandas().set_index("k").sort_index()
    src = df.toPandas().set_index("k").sort_index()
    obs = src.notna()
    assert (out[obs] == src[obs]).sum().sum() == obs.sum().sum()
    assert out.notna().all().all()
    # a is well predicted from b and c where it was missing
    miss = src.a.isna()
    assert np.abs(out.a[miss] - x[miss.to_numpy()]).mean() < 0.2


def test_no_leakage_from_held_out_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.uniform() < 0.4), float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    train = df.where(F.col("k") < 150)
    pipe = M.classifier_pipeline(["a", "b"], "y", reg=0.1)
    m1 = pipe.fit(train)
    changed = df.withColumn("a", F.when(F.col("k") >= 150, F.col("a") * 100).otherwise(F.col("a")))
    m2 = pipe.fit(changed.where(F.col("k") < 150))
    assert list(m1.stages[-1].coefficients) == pytest.approx(list(m2.stages[-1].coefficients))


def test_permutation_refit_mode(spark):
    from cohortlab.operators.cv import permutation_test_refit
    rng = np.random.default_rng(12)
    rows = [(i, int(rng.uniform() < 0.4), float(rng.normal()), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    res = permutation_test_refit(df, "k", "y", ["a", "b"], true_score=0.99, n_permutations=3,
                                 train_size=0.3).first()
    assert res.n_null == 3 and res.n_exceed == 0
    assert res.p_value == pytest.approx(1 / 4)


def test_degenerate_groups_give_null_not_errors(spark):
    # ANSI mode is on: a constant column, a missing group and a constant flag
    # must give NULL statistics rather than failing with division by zero.
    df = spark.createDataFrame([(1, 5.0, 0), (1, 5.0, 0), (0, 5.0, 0), (0, 5.0, 0)], "g int, x double, f int")
    t = ST.ttest(df, ["x"], "g", 1, 0).first()
    assert t.t is None and (t.p is None or math.isnan(t.p))
    assert ST.ttest(df, ["x"], "g", 1, 7).first().t is None
    a = ST.anova_f(df, ["x"], "g").first()
    assert a.F is None
    c = ST.chi2_independence(df, ["f"], "g").first()
    assert c.dof == 0 and c.p is None
    k = ST.kruskal(df, "x", "g").first()
    assert k.H is None
