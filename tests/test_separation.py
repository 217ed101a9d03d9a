"""Separated terms of the logistic model against all extreme rays of the cone."""

from itertools import combinations

import numpy as np
import pytest

from cohortlab.operators import models as M
from cohortlab.operators import separation as S


def brute(x: np.ndarray, y: np.ndarray) -> list[str] | None:
    """Status by term for an intercept and two columns of small integers, exactly;
    None if the columns are not independent."""
    z = np.column_stack([np.ones(len(x), int), x]) * np.where(y == 1, 1, -1)[:, None]
    if np.linalg.matrix_rank(z) < 3:
        return None
    rays = [v for a, b in combinations(z, 2) for w in [np.cross(a, b)] for v in (w, -w) if v.any() and (z @ v >= 0).all()]
    rest = z[~(np.array([z @ v for v in rays]) > 0).any(axis=0)] if rays else z
    if not len(rest):
        return ["separated"] * 3
    free = [j for j in range(3) if np.linalg.matrix_rank(np.vstack([rest, np.eye(3, dtype=int)[j]])) > np.linalg.matrix_rank(rest)]
    return ["separated" if j in free else "estimated" for j in range(3)]


def fit(spark, x, y):
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y)]
    table, stats = M.logit_fit(spark.createDataFrame(rows, "a double, b double, y int").repartition(3), "y", ["a", "b"])
    return table.collect(), stats


def cases():
    rng, found = np.random.default_rng(4), {}
    while len(found) < 4 or min(map(len, found.values())) < 2:
        n = int(rng.integers(6, 14))
        x = rng.integers(0, 3, (n, 2)) * np.array([1, 4])
        y = (x[:, 0] + rng.integers(-1, 2, n) > 1).astype(int)
        want = brute(x, y)
        if want is not None and len(found.setdefault(tuple(want), [])) < 2:
            found[tuple(want)].append((x, y))
    return [(w, x, y) for w, some in found.items() for x, y in some]


@pytest.mark.parametrize("want,x,y", cases())
def test_status_of_small_tables(spark, want, x, y):
    got, _ = fit(spark, x, y)
    assert tuple(r.status for r in got) == want
    assert all((r.coef is None) == (r.status != "estimated") for r in got)


def test_threshold_overlap_and_aliased(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=400), rng.normal(size=400) * 1e5
    apart, stats = fit(spark, np.column_stack([a, b]), a > 0.2)
    assert [r.status for r in apart] == ["separated"] * 3 and stats["llf"] == 0.0 and stats["n"] == 400
    y = (a + rng.normal(size=400) > 0.2).astype(int)
    clean, _ = fit(spark, np.column_stack([a, b]), y)
    assert [r.status for r in clean] == ["estimated"] * 3
    design = np.column_stack([np.ones(400), a, b])
    share = 1 / (1 + np.exp(-design @ np.array([r.coef for r in clean])))
    assert np.abs(design.T @ (y - share) / np.linalg.norm(design, axis=0)).max() < 1e-5
    same, _ = fit(spark, np.column_stack([a, 2 * a - 1]), y)
    assert [r.status for r in same] == ["estimated", "estimated", "aliased"]


def test_one_class_constant_and_no_rows(spark):
    x = np.array([[0, 1], [1, 1], [2, 1], [3, 1]])
    none, _ = fit(spark, x, np.zeros(4))
    assert [r.status for r in none] == ["separated", "separated", "aliased"]
    got, stats = fit(spark, np.ones((4, 2)), np.array([1, 0, 0, 0]))
    assert [r.status for r in got] == ["estimated", "aliased", "aliased"]
    assert got[0].coef == pytest.approx(np.log(1 / 3)) and stats["k"] == 1
    empty = spark.createDataFrame([], "a double, b double, y int")
    table, stats = M.logit_fit(empty, "y", ["a", "b"])
    assert [r.coef for r in table.collect()] == [None] * 3 and stats["n"] == 0


def test_nearest_point_of_a_cone():
    rng = np.random.default_rng(7)
    for _ in range(50):
        rows, s = rng.normal(size=(12, 4)), rng.normal(size=4)
        point, held = S.nearest(s, rows)
        assert (rows @ point >= -1e-7).all()
        # Moreau: what was taken off is a combination of the rows held, at a right angle to the point.
        assert abs(point @ (s - point)) < 1e-7 and len(held) <= 4
