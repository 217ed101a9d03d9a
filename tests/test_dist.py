"""Tail probabilities: Spark column expressions against the JVM's
commons-math3 distributions and against the DuckDB SQL twins."""

import math

import duckdb
import pytest

from cohortlab.functions import dist as D

CASES = [(0.1, 1.0), (1.5, 3.0), (2.0, 10.0), (0.3, 60000.0), (-2.5, 7.5), (4.0, 700.0), (7.0, 2.0)]


@pytest.fixture(scope="module")
def values(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in CASES], "x double, df double")
    return df.select(
        "x", "df",
        D.t_sf_two_sided("x", "df").alias("t2"),
        D.chi2_sf("abs(x) * 3", "df").alias("c"),
        D.f_sf("abs(x)", 3.0, "df").alias("f"),
        D.norm_sf("x").alias("n"),
        D.norm_cdf("x").alias("ncdf"),
    ).collect()


def test_against_jvm(spark, values):
    cm = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for r in values:
        x, d = r.x, r.df
        assert r.t2 == pytest.approx(2 * (1 - cm.TDistribution(d).cumulativeProbability(abs(x))), abs=1e-9)
        assert r.c == pytest.approx(1 - cm.ChiSquaredDistribution(d).cumulativeProbability(abs(x) * 3), abs=1e-9)
        assert r.f == pytest.approx(1 - cm.FDistribution(3.0, d).cumulativeProbability(abs(x)), abs=1e-9)
        assert r.n == pytest.approx(1 - cm.NormalDistribution().cumulativeProbability(x), abs=1e-12)
        assert r.n + r.ncdf == pytest.approx(1.0, abs=1e-12)


def test_sql_twins(values):
    con = duckdb.connect()
    for r in values:
        x, d = r.x, r.df
        q = "SELECT " + ", ".join([
            D.sql_t_sf_two_sided(f"{x}", f"{d}"), D.sql_chi2_sf(f"{abs(x) * 3}", f"{d}"),
            D.sql_f_sf(f"{abs(x)}", "3.0", f"{d}"), D.sql_norm_sf(f"({x})")])
        got = con.sql(q).fetchall()[0]
        assert got == pytest.approx((r.t2, r.c, r.f, r.n), abs=1e-9)


def test_edges(spark):
    row = spark.range(1).select(
        D.chi2_sf(0.0, 2.0).alias("a"),
        D.f_sf(0.0, 1.0, 5.0).alias("b"),
        D.t_sf_two_sided(0.0, 5.0).alias("c"),
        D.chi2_sf("CAST(NULL AS DOUBLE)", 2.0).alias("d"),
        D.chi2_sf(12.49983, 6.0).alias("e"),
        D.chi2_sf(5.0, 2.0).alias("g"),
        D.lgamma(5.0).alias("lg"),
    ).first()
    assert row.a == 1.0 and row.b == 1.0 and row.c == pytest.approx(1.0)
    assert row.d is None
    assert row.lg == pytest.approx(math.log(24.0), rel=1e-14)
    assert row.e == pytest.approx(0.05170, abs=5e-6)
    assert row.g == pytest.approx(math.exp(-2.5), rel=1e-12)
