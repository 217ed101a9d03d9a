"""Missing values, hot values and large numbers: each case has one defined result."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import dist as D
from cohortlab.functions import scalar as S
from cohortlab.operators import describe as A
from cohortlab.operators import design, figures
from cohortlab.operators import joins as J
from cohortlab.operators import profile as PR
from cohortlab.operators import ranks as W
from cohortlab.operators import rows as R
from cohortlab.operators import stattests as ST
from cohortlab.operators import validate as V
from cohortlab.session import stages
from cohortlab.sources import io


def test_exclude_keys_same_answer_for_any_list(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    for keys in ([1], [1, None], [1, *range(10, 2000)]):
        frame = spark.createDataFrame([(k,) for k in keys], "k long")
        for given in (keys, frame):
            assert sorted(str(r.k) for r in R.exclude_keys(df, "k", given).collect()) == ["2", "None"]
    assert R.exclude_keys(df, "k", []).count() == 3


def test_nan_is_missing_everywhere(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, 3.0)], "k int, v double")
    assert {r.column: r.percent_missing for r in PR.na_percent(df).collect()}["v"] == 50.0
    assert R.filter_notnull(df, "v").count() == R.complete_cases(df, ["v"]).count() == 2
    d = A.describe(df, ["v"]).first()
    assert (d["count"], d["mean"], d["p50"], d["max"]) == (2, 2.0, 2.0, 3.0)
    assert "v" not in PR.drop_sparse(df, 0.5).columns
    df.write.parquet(f"{tmp_path}/p")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    assert io.load(spark, f"{tmp_path}/p").where("v is null").count() == 2
    assert io.read_csv(spark, f"{tmp_path}/c", "k int, v double").where("v is null").count() == 2
    assert W.midranks(df, [], "v").count() == 2


def test_null_parts_and_labels_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "a", None if i % 10 == 0 else i % 2, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g string, y int, v double")
    got = {r.g: r for r in A.describe(df, ["v"], by=["g"], digits=None).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "g", "y", "v"])
    for g in (None, "a"):
        sub = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        assert [got[g].p25, got[g].p50, got[g].p75] == pytest.approx(np.quantile(sub.v, [0.25, 0.5, 0.75]))
    for df2 in (df, df.withColumn("k", F.concat(F.lit("GWAS_ID_"), "k"))):
        for seed in (3, None):
            folds = V.stratified_folds(df2, "k", "y", k=3, seed=seed)
            assert folds.count() == 60 and folds.where("y is null").groupBy("fold").count().count() == 3
        assert V.stratified_split(df2, "k", "y", 0.5).count() == 60
        permuted = V.permute_labels(df2, "k", "y", seed=1).toPandas()
        assert sorted(permuted.permuted.fillna(-1)) == sorted(permuted.y.fillna(-1)) and (permuted.permuted.fillna(-1) != permuted.y.fillna(-1)).any()


def test_unseeded_folds_follow_the_key_order(spark):
    keys = [f"id_{i:04d}" for i in range(200)]
    df = spark.createDataFrame([(k, 1) for k in reversed(keys)], "k string, y int")
    folds = {r.k: r.fold for r in V.stratified_folds(df, "k", "y", k=7, seed=None).collect()}
    assert folds == {k: i % 7 for i, k in enumerate(keys)}


def test_ranks_with_infinity_and_outliers(spark):
    rows = [("a", float(i)) for i in range(300)] + [("b", float(i)) for i in range(300)]
    rows += [("a", 1e18), ("b", float("inf")), ("b", float("-inf")), ("a", -1e18)]
    df = spark.createDataFrame(rows, "p string, v double")
    c = W.cumulative(df, ["p"], "v", buckets=40).collect()
    pdf = pd.DataFrame(rows, columns=["p", "v"])
    want = {(p, v): r for p, v, r in zip(pdf.p, pdf.v, pdf.groupby("p").v.rank(method="max"))}
    assert {(r.p, r.v): float(r._cum) for r in c} == want
    q = {r.p: r for r in W.exact_quantiles(df, ["p"], "v", [0.0, 0.5, 1.0], ["lo", "mid", "hi"]).collect()}
    assert (q["b"].lo, q["b"].mid, q["b"].hi) == (float("-inf"), 149.5, float("inf"))


def test_quantiles_of_many_rows_with_ties(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(30_000, 5.0), rng.normal(5, 3, 40_000).round(2)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = W.exact_quantiles(df, [], "v", probs, list("abcdef")).first()
    assert [got[c] for c in "abcdef"] == pytest.approx(list(np.quantile(v, probs)))


def test_bh_leaves_out_null_p(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, float("nan"))], "t int, p double")
    got = {r.t: (r.p_fdr, r.reject) for r in W.fdr_bh(df, "p", order_tie=["t"]).collect()}
    assert got == {1: (0.02, True), 2: (0.04, True), 3: (None, None), 4: (None, None)}
    flags = spark.createDataFrame([(i % 2, int(i % 3 == 0), 1) for i in range(60)], "y int, f int, always int")
    out = {r.flag: r for r in ST.flag_summary_with_p(flags, ["f", "always"], "y").collect()}
    assert out["always"].p is None and out["always"].p_fdr is None and out["f"].p_fdr == out["f"].p


def test_tests_do_not_lose_digits(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(x)) for g in (0, 1, 2) for x in rng.normal(g * 0.2, 1, 600)]
    near = spark.createDataFrame(rows, "g int, x double")
    far = near.withColumn("x", F.col("x") + 1e9)
    a, b = ST.anova_f(near, ["x"], "g").first(), ST.anova_f(far, ["x"], "g").first()
    assert b.F == pytest.approx(a.F, rel=1e-5)
    a, b = ST.levene_median(near, ["x"], "g").first(), ST.levene_median(far, ["x"], "g").first()
    assert b.F == pytest.approx(a.F, rel=1e-4)


def test_mann_whitney_keeps_every_part(spark):
    rows = [("two", "a", 1.0), ("two", "b", 2.0), ("two", "a", 3.0), ("one", "a", 1.0), ("three", "a", 1.0), ("three", "b", 2.0), ("three", "c", 3.0)]
    got = {r.part: r for r in ST.mann_whitney(spark.createDataFrame(rows, "part string, g string, v double"), "v", "g", "a", part=["part"]).collect()}
    assert {p: r.n_groups for p, r in got.items()} == {"one": 1, "two": 2, "three": 3}
    assert got["one"].U is None and got["three"].p is None and got["two"].U is not None


def test_recode_number_to_text(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    got = [r.x for r in df.select(S.recode_map("x", {0: "no", 1: "yes"}).alias("x")).collect()]
    assert got == ["no", "yes", "2", None]


def test_malformed_ids_join_nothing(spark):
    parts = {"a": spark.createDataFrame([("GWAS_ID_1", 1.0), ("GWAS_ID_x", 2.0), ("GWAS_ID_z", 5.0)], "IID string, SCORE double"),
             "b": spark.createDataFrame([("GWAS_ID_1", 3.0), ("GWAS_ID_y", 4.0)], "IID string, SCORE double")}
    assert [tuple(r) for r in J.parse_and_fold(parts, "IID", "SCORE", 8).collect()] == [(1, 1.0, 3.0)]
    assert {r.part: r.n_rejected for r in J.parse_rejects(parts, "IID", 8).collect()} == {"a": 2, "b": 1}


def test_formula_terms(spark):
    assert design._expand_terms(["a*b*c"]) == [["a"], ["b"], ["c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "g string, v double")
    _, safe, _ = design.design_columns(df, ["g", "v"])
    assert safe == ["g_T_y", "g_T_z", "v"]


def test_crosstab_without_level_limit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1)], "x string, y int")
    got = sorted(tuple(r) for r in A.crosstab(df, "x", "y", max_levels=1, zero_cells=False).collect())
    assert got == [("a", 1, 2), ("b", 2, 1)]


def test_group_statistics_do_not_deal_out_the_data(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).selectExpr("id % 3 as g", "rand(1) as v")
        for out in (figures.histogram_by_group(df, "v", "g"), figures.kde_by_group(df, "v", "g", grid=4)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tail_probabilities_against_closed_forms(spark):
    """Even degrees of freedom have finite sums; large ones tend to the normal law."""
    rows = []
    for df_ in (2, 4, 10):
        for x in (1.0, 5.0, 20.0, 60.0):
            q = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df_ // 2))
            rows.append((x, float(df_), q))
    got = spark.createDataFrame(rows, "x double, d double, q double").select(D.chi2_sf("x", "d").alias("p"), "q").collect()
    assert all(r.p == pytest.approx(r.q, rel=1e-10) for r in got)
    # Student: df = 2 and 4 in closed form, down to 1e-12
    rows = []
    for t in (0.5, 3.0, 40.0, 1e6):
        two = 1 - t / math.sqrt(2 + t * t) if t < 10 else (lambda u: u / (1 + math.sqrt(1 - u)))(2 / (2 + t * t))
        rows.append((t, 2.0, two))
    # normal limit: erfc(t / sqrt 2) (1 + (t^3 + t) phi / (4 df p / 2) ...) is below 1e-6 relative at df 1e8
    for t in (0.5, 2.0, 5.0, 7.0):
        for d in (1e9, 1e12):
            rows.append((t, d, math.erfc(t / math.sqrt(2))))
    got = spark.createDataFrame(rows, "t double, d double, q double").select(D.t_sf_two_sided("t", "d").alias("p"), "q", "t", "d").collect()
    for r in got:
        assert r.p == pytest.approx(r.q, rel=1e-9 if r.d < 10 else 1e-6), (r.t, r.d)
    # both sides of the switch agree
    both = spark.createDataFrame([(t, d) for t in (0.3, 2.0, 6.0) for d in (99_999.0, 100_001.0)], "t double, d double").select("t", "d", D.t_sf_two_sided("t", "d").alias("p"), D.f_sf("t*t", 1.0, "d").alias("f")).collect()
    for r in both:
        assert r.f == pytest.approx(r.p, rel=1e-9)
    by = {(r.t, r.d): r.p for r in both}
    for t in (0.3, 2.0, 6.0):
        assert by[t, 99_999.0] == pytest.approx(by[t, 100_001.0], rel=2e-8 * t**4 + 1e-9)


def test_permutation_null_bins(spark, monkeypatch):
    """Cutting the hash order in bins changes nothing."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.uniform() < 0.4), float(rng.integers(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y int, s double")
    whole = {r.perm: r.auc for r in V.permutation_null_auc(df, "k", "y", "s", 20, seed=4).collect()}
    monkeypatch.setattr(V, "ORDERED_ROWS", 16)
    assert {r.perm: pytest.approx(r.auc) for r in V.permutation_null_auc(df, "k", "y", "s", 20, seed=4).collect()} == whole
    assert len(whole) == 20


@pytest.mark.parametrize("n, block", [(6000, 2), (150_000, 16)])  # parts ordered whole, and by brackets
def test_column_quantiles_equal_numpy(spark, monkeypatch, n, block):
    monkeypatch.setattr(W, "COLUMNS_AT_ONCE", block)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(np.array(["a", "b", None], dtype=object), n, p=[0.4, 0.4, 0.2]),
                        "x": np.where(rng.random(n) < 0.3, 5.0, rng.normal(5, 3, n).round(2)),
                        "y": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n))})
    df = spark.createDataFrame(pdf).select("g", "x", "y", F.lit(None).cast("double").alias("none"))
    probs, names = [0.0, 0.25, 0.5, 0.9, 1.0], list("abcde")
    got = {(r.g, r.column): r for r in W.column_quantiles(df, ["g"], ["x", "y", "none"], probs, names, {"top": F.max}).collect()}
    assert len(got) == 9
    for (g, c), r in got.items():
        v = pdf[pdf.g.isna() if g is None else pdf.g == g][c].dropna() if c != "none" else pd.Series(dtype="float64")
        assert r.n == len(v)
        assert [r[k] for k in names] == (pytest.approx(list(np.quantile(v, probs))) if len(v) else [None] * 5)
        assert r.top == (v.max() if len(v) else None)
    whole = {r.column: r for r in W.column_quantiles(df, [], ["x", "none"], [0.5], ["m"]).collect()}
    assert (whole["x"].m, whole["none"].m, whole["none"].n) == (pytest.approx(np.median(pdf.x)), None, 0)
    empty = df.where("x > 1e9")
    assert [(r.column, r.n, r.m) for r in W.column_quantiles(empty, [], ["x"], [0.5], ["m"]).collect()] == [("x", 0, None)]
    assert W.column_quantiles(empty, ["g"], ["x"], [0.5], ["m"]).collect() == []


def test_bounded_distinct_sets(spark):
    df = spark.range(5000).selectExpr("id % 6 as six", "id % 7 as seven", "-cast(id as double) / 3 as many", "cast(null as int) as nothing",
                                      "if(id % 2 = 0, double('nan'), 1.5) as nan", "-(id % 63) as below", "-(id % 64) as full")
    for exact in (True, False):
        got = {r.column: (r.n_distinct, r.inferred) for r in PR.infer_types(df, exact_counts=exact).collect()}
        assert got["six"] == (6, "category") and got["seven"] == (7, "double") and got["below"] == (63, "double")
        assert got["nothing"] == (None, "double")
        assert got["many"] == (5000 if exact else None, "double") and got["full"] == (64 if exact else None, "double")
    plan = df.agg(PR.distinct_sketch(F.col("many")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan  # partial sets only


def test_stages_are_deleted_by_their_owner(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "cast(id as double) as v")
    with stages(spark) as written:
        assert A.describe(df, ["v"], by=["g"]).count() == 3
        assert written and all(os.path.isdir(p.removeprefix("file:")) for p in written)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in written)
