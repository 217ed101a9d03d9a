"""The density table against the plain sum of kernels."""

import math

import numpy as np
import pytest

from cohortlab.operators import figures as FG


def test_series_bound():
    # |H_p(u) exp(-u^2)| <= 1.09 sqrt(2^p p!), and |t| <= 1 / (2 sqrt(2)).
    rest = sum(1.09 * (2 ** -1.5) ** p * math.sqrt(2.0 ** p / math.factorial(p)) for p in range(FG.MOMENTS + 1, 120))
    assert rest < 1e-11


@pytest.mark.parametrize("bandwidth", [None, 0.01, 40.0])
def test_density_is_the_sum_of_kernels(spark, bandwidth):
    rng = np.random.default_rng(3)
    values = {"a": np.concatenate([rng.normal(5, 2, 700), [5.0] * 300, [60.0]]), "b": rng.exponential(1000, 90) + 1e6, "c": np.array([4.0]), "d": np.array([2.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), (None, 1.0)]
    got = FG.kde_by_group(spark.createDataFrame(rows, "g string, v double"), "v", "g", 33, bandwidth).toPandas()
    assert len(got) == 4 * 33
    for g, v in values.items():
        h = bandwidth or (len(v) ** -0.2 * np.std(v, ddof=1) if len(v) > 1 else 0.0)
        mine = got[got.g == g].sort_values("point")
        x = np.linspace(v.min(), v.max(), 33)
        assert np.allclose(mine.x, x)
        if not h > 0:
            assert mine.density.isna().all()
            continue
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.abs(mine.density - want).max() < 1e-8 / h
