"""Golden vectors: results printed in the reference next to their inputs."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.scalar import aic
from cohortlab.operators import figures as FG
from cohortlab.operators import ranks as W
from cohortlab.operators import stattests as ST

# Outer-fold scores of seven models, as listed in the reference.
SCORES = {
    "multi": [0.68, 0.78, 0.63, 0.73, 0.45, 0.82, 0.77, 0.82, 0.61, 0.46],
    "clin": [0.64, 0.61, 0.6, 0.7, 0.42, 0.74, 0.77, 0.74, 0.56, 0.5],
    "bio": [0.61, 0.63, 0.59, 0.75, 0.6, 0.59, 0.3, 0.6, 0.56, 0.49],
    "serum": [0.58, 0.58, 0.71, 0.44, 0.45, 0.6, 0.5, 0.56, 0.46, 0.56],
    "smri": [0.47, 0.63, 0.7, 0.58, 0.59, 0.51, 0.37, 0.67, 0.49, 0.67],
    "cardio": [0.67, 0.68, 0.36, 0.74, 0.45, 0.57, 0.56, 0.63, 0.59, 0.36],
    "pgrs": [0.42, 0.73, 0.44, 0.36, 0.51, 0.5, 0.34, 0.48, 0.74, 0.53],
}
# Printed Mann-Whitney results, multi against each model.
MW_EXPECTED = {"clin": (36.0, 0.1534), "bio": (24.0, 0.0267), "serum": (19.0, 0.0104),
               "smri": (26.5, 0.0409), "cardio": (24.5, 0.0292), "pgrs": (19.5, 0.0116)}
# Raw and BH-corrected p-values as printed in the reference.
RAW_P = [0.15, 0.0267, 0.0104, 0.0409, 0.0292, 0.0116]
BH_P = [0.15, 0.0438, 0.0348, 0.04908, 0.0438, 0.0348]
# AUC per outer fold of six models (figure script).
AUC_LISTS = {
    "C-Multi": [0.820843, 0.826107, 0.892954, 0.742999, 0.756549, 0.827010, 0.777326, 0.777778, 0.712963, 0.700463],
    "Multi": [0.787716, 0.816810, 0.815733, 0.630388, 0.686422, 0.838362, 0.654095, 0.745690, 0.608454, 0.645161],
    "Serum": [0.712284, 0.716595, 0.831897, 0.676724, 0.730603, 0.877155, 0.543103, 0.724138, 0.579533, 0.692396],
    "Cardio": [0.725216, 0.728448, 0.789871, 0.667026, 0.614224, 0.581897, 0.691810, 0.741379, 0.640712, 0.509217],
    "sMRI": [0.532328, 0.523707, 0.544181, 0.494612, 0.629310, 0.549569, 0.647629, 0.563578, 0.611791, 0.662442],
    "SNP": [0.465517, 0.549569, 0.573276, 0.520474, 0.302802, 0.540948, 0.559267, 0.451509, 0.585095, 0.550691],
}
AUC_EXPECTED = {"C-Multi": (0.783499, 0.056028), "Multi": (0.722883, 0.083219),
                "Serum": (0.708443, 0.094732), "Cardio": (0.668980, 0.079991),
                "sMRI": (0.575915, 0.054642), "SNP": (0.509915, 0.080430)}


def _long(spark, lists, name="model"):
    rows = [(m, i, float(v)) for m, vs in lists.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"{name} string, fold int, score double")


def test_g1_mann_whitney(spark):
    base = _long(spark, SCORES)
    parts = []
    for other in MW_EXPECTED:
        parts.append(base.where(F.col("model").isin("multi", other)).withColumn("cmp", F.lit(other)))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    res = {r.cmp: r for r in ST.mann_whitney(df, "score", "model", "multi", part=["cmp"]).collect()}
    for other, (u, p) in MW_EXPECTED.items():
        assert res[other].U == pytest.approx(u)
        assert round(res[other].p, 4) == pytest.approx(p, abs=1e-4)


def test_g2_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(RAW_P)], "test int, p double")
    got = {r.test: r.p_fdr for r in W.fdr_bh(df, "p", order_tie=["test"]).collect()}
    for i, q in enumerate(BH_P):
        assert got[i] == pytest.approx(q, abs=5e-5)


def test_g3_kruskal(spark):
    r = ST.kruskal(_long(spark, SCORES), "score", "model").first()
    assert r.H == pytest.approx(12.49983, abs=1e-5)
    assert r.df == 6
    assert r.p == pytest.approx(0.05170, abs=1e-5)


def test_g4_aic(spark):
    r = spark.range(1).select(aic(F.lit(-152.36), F.lit(22)).alias("a")).first()
    assert r.a == pytest.approx(348.72)


def test_g5_errorbars(spark):
    res = {r.model: r for r in FG.errorbar_scores(_long(spark, AUC_LISTS)).collect()}
    for m, (mean, sd) in AUC_EXPECTED.items():
        assert res[m].mean == pytest.approx(mean, abs=1e-6)
        assert res[m].sd == pytest.approx(sd, abs=1e-6)
        assert res[m].n == 10


def test_two_sided_convention(spark):
    base = _long(spark, {"multi": SCORES["multi"], "clin": SCORES["clin"]})
    leg = ST.mann_whitney(base, "score", "model", "multi").first()
    two = ST.mann_whitney(base, "score", "model", "multi", alternative="two-sided").first()
    assert two.p == pytest.approx(min(1.0, 2 * leg.p))
    assert two.U == pytest.approx(100 - 36.0) or two.U == pytest.approx(36.0)
    assert math.isfinite(two.z)
