"""The four-stage pipeline: every stage against a plain version, and no held-out row in any fit."""

import json
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import pipeline as PL

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        a = rng.normal()
        b, c, d = 2 * a + rng.normal() * 0.1, rng.normal(), rng.normal() * 3 + 5
        y = int(a + 0.5 * c + rng.normal() * 0.5 > 0.4)
        rows.append((f"s{i:03d}", y, a if i % 7 else None, b if i % 5 else float("nan"), c, d))
    return spark.createDataFrame(rows, "k string, y int, a double, b double, c double, d double").repartition(2).cache()


def test_imputer_keeps_observed_and_predicts_the_rest(spark, table):
    imputer = PL.fit_imputer(table, FEATURES, rounds=3)
    got = imputer.transform(table).toPandas().set_index("k")
    raw = table.toPandas().set_index("k")
    seen = raw[FEATURES].notna()
    assert (got[FEATURES].to_numpy()[seen.to_numpy()] == raw[FEATURES].to_numpy()[seen.to_numpy()]).all()
    assert got[FEATURES].notna().all().all() and got.columns.tolist() == raw.columns.tolist()
    gap = raw.a.isna() & raw.b.notna()
    assert np.abs(got.a[gap] - raw.b[gap] / 2).mean() < 0.15


def test_imputer_is_a_plain_ridge_regression(spark, table):
    """One gap column: each round is the same regression on the observed rows."""
    df = table.select("k", "a", "c", "d")
    imputer = PL.fit_imputer(df, ["a", "c", "d"], rounds=1, reg=0.0)
    raw = df.toPandas()
    raw = raw[raw.a.notna()]
    x = np.c_[np.ones(len(raw)), raw.c, raw.d]
    want = np.linalg.lstsq(x, raw.a, rcond=None)[0]
    m = imputer.rounds[0][0]
    assert m.target == 0 and [m.intercept, *[m.coefs[m.predictors.index(j)] for j in (1, 2)]] == pytest.approx(list(want))


def test_column_without_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "k int, a double, b double")
    got = PL.fit_imputer(df, ["a", "b"]).transform(df).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 2.0), (0.0, 3.0)]
    s = PL.fit_scaler(df.withColumn("a", F.lit(1.0)), ["a", "b"])
    assert s.sds[0] == 1.0 and s.sds[1] == 0.5


def test_selectors(spark, table):
    z = PL.fit_imputer(table, FEATURES).transform(table)
    z = PL.compact(PL.fit_scaler(z, FEATURES).transform(z))
    assert PL.fit_selector(z, FEATURES, "y", None).names == FEATURES
    top = PL.fit_selector(z, FEATURES, "y", "f_test", k=2)
    assert set(top.names) <= {"a", "b"} and len(top.scores) == 4
    net = PL.fit_selector(z, FEATURES, "y", "elastic_net", alpha=0.05, l1_ratio=1.0)
    assert "d" not in net.names and set(net.names) & {"a", "b"}
    assert len(PL.fit_selector(z, FEATURES, "y", "elastic_net", alpha=100.0, l1_ratio=1.0).names) == 1
    with pytest.raises(ValueError):
        PL.fit_selector(z, FEATURES, "y", "other")


def test_svm_is_balanced_and_calibrated(spark, table):
    z = PL.compact(table.select("k", "y", "c", "d"))
    svm = PL.calibrate(z, "k", ["c", "d"], "y", 1.0)
    got = z.select("y", svm.margin().alias("m"), svm.probability().alias("p")).toPandas()
    assert got.p.between(0, 1).all() and svm.a > 0
    assert abs(got.p.mean() - got.y.mean()) < 0.1
    order = got.sort_values("m").p.to_numpy()
    assert (np.diff(order) >= -1e-12).all()


def test_no_held_out_row_reaches_a_fit(spark, table):
    """Changing the held-out rows beyond recognition changes no number of the fitted pipeline."""
    train = table.where("k < 's160'")
    wild = table.withColumns({c: F.when(F.col("k") >= "s160", F.lit(1e6)).otherwise(F.col(c)) for c in FEATURES}).withColumn("y", F.when(F.col("k") >= "s160", 1 - F.col("y")).otherwise(F.col("y")))
    one = PL.fit(train, "k", "y", FEATURES, PL.cells()[0])
    two = PL.fit(wild.where("k < 's160'"), "k", "y", FEATURES, PL.cells()[0])
    for stage in ("imputer", "scaler", "selector", "svm"):
        a, b = (json.dumps(asdict(x)[stage]) for x in (one, two))
        assert _numbers(a) == pytest.approx(_numbers(b), rel=1e-9, abs=1e-12), stage
    assert one.transform(table, ["k"]).count() == 240


def _numbers(text):
    out = []

    def walk(x):
        if isinstance(x, dict):
            for k in sorted(x):
                walk(x[k])
        elif isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, (int, float)):
            out.append(float(x))

    walk(json.loads(text))
    return out


def test_saved_pipeline_is_the_same(spark, table, tmp_path):
    model = PL.fit(table, "k", "y", FEATURES, {"cost": 1.0, "alpha": 0.01, "l1_ratio": 0.5})
    again = PL.Fitted.load(spark, model.save(spark, f"{tmp_path}/m"))
    assert again == model
    names = [r.feature for r in PL.selected(spark, model).collect()]
    assert sorted(names) == sorted(model.selector.names)


def test_nested_validation(spark, table):
    found = PL.nested(table, "k", "y", FEATURES, PL.cells(costs=(0.1, 1.0)), outer_k=2, inner_k=2, inner_repeats=2, metric="balanced_accuracy")
    oof = found.oof.toPandas()
    assert sorted(oof.k) == [f"s{i:03d}" for i in range(240)] and oof.prob.between(0, 1).all()
    scores = found.scores.toPandas()
    assert len(scores) == 2 * 2 * 9 and scores[(scores.metric == "auc") & (scores.split == "test")].score.min() > 0.7
    assert found.params.where("inner_score is not null").count() == 2 and len(found.models) == 2
