"""Common passes over many models: against the same fits from rows, closed forms and certificates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import batch as B
from cohortlab.operators import models as M
from cohortlab.operators import pipeline as PL
from cohortlab.operators import validate as V

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        a = rng.normal(50, 10)
        b, c, d = 3 * a + rng.normal() * 4, rng.normal(), 7.0
        y = int(0.1 * (a - 50) + 0.5 * c + rng.normal() > 0.4)
        gap = lambda x, p: None if rng.uniform() < p else float(x)
        rows.append((i, y, gap(a, 0.2), gap(b, 0.3), gap(c, 0.1), d))
    return spark.createDataFrame(rows, "k long, y int, a double, b double, c double, d double").repartition(3).cache()


@pytest.mark.parametrize("rounds, reg", [(0, 1e-3), (1, 0.0), (4, 1e-3)])
def test_imputer_from_moments_equals_rows(spark, table, rounds, reg):
    one = PL.fit_imputer(table, FEATURES, rounds=rounds, reg=reg or 1e-12)
    two = PL.fit_imputer_by_rows(table, FEATURES, rounds=rounds, reg=reg or 1e-12)
    assert one.means == pytest.approx(two.means, rel=1e-12) and len(one.rounds) == len(two.rounds)
    for x, y in zip(one.rounds, two.rounds):
        assert [m.target for m in x] == [m.target for m in y]
        for m, n in zip(x, y):
            assert dict(zip(m.predictors, m.coefs)) == pytest.approx(dict(zip(n.predictors, n.coefs)), rel=1e-7, abs=1e-9)
            assert m.intercept == pytest.approx(n.intercept, rel=1e-7, abs=1e-9)
    a, b = (x.transform(table).select("k", *FEATURES).orderBy("k").toPandas().to_numpy() for x in (one, two))
    assert np.abs(a - b).max() < 1e-9 * np.abs(b).max()


def test_folds_of_one_pass_equal_separate_fits(spark, table):
    data = table.withColumn("f", (F.col("k") % 3).cast("int"))
    rows = B.Rows.of(data, "y", FEATURES, ["f"])
    found = PL.prepare_all(rows, [((0, f, False),) for f in range(3)], PL.Settings())
    for f, (imputer, scaler) in enumerate(found):
        part = data.where(F.col("f") != f)
        alone = PL.fit_imputer_by_rows(part, FEATURES)
        want = PL.fit_scaler(alone.transform(part), FEATURES)
        assert scaler.means == pytest.approx(want.means, rel=1e-9) and scaler.sds == pytest.approx(want.sds, rel=1e-9)


def test_limits_are_kept_by_rows(spark, table, monkeypatch):
    """Where a prediction may leave the limits, and where patterns are too many, rows are read; results are the same."""
    tight = PL.fit_imputer(table, FEATURES, low=45.0, high=160.0)
    rows = PL.fit_imputer_by_rows(table, FEATURES, low=45.0, high=160.0)
    got, want = (x.transform(table).select("k", *FEATURES).orderBy("k").toPandas().to_numpy() for x in (tight, rows))
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()
    with pytest.raises(B.Unbounded):
        B.chained(B.moments(B.Rows.of(table, "y", FEATURES, []), [()]), 0, FEATURES, 3, 10, 1e-3, 45.0, 160.0)
    monkeypatch.setattr(B, "MAX_PATTERNS", 2)
    many = PL.fit_imputer(table, FEATURES)
    assert many.means == pytest.approx(PL.fit_imputer_by_rows(table, FEATURES).means)


def local(problem, x, y):
    while not problem.done:
        problem.update(problem.sums(x, y))
    return problem


@pytest.mark.parametrize("n, p, cost, signal, seed", [(160, 2, 1.0, 1, 0), (2000, 5, 0.001, 0, 1), (300, 40, 1.0, 2, 2), (200, 3, 1.0, 100, 3), (60, 1, 100.0, 1, 4)])
def test_svm_has_a_certificate(n, p, cost, signal, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (signal * x[:, 0] + rng.normal(size=n) > 0.5).astype(int)
    fit = local(B.Hinge(0, (), np.arange(p), cost=cost, counts=(float((y == 0).sum()), float((y == 1).sum()))), x, y)
    c = cost * n / 2 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())

    def objective(point):
        return point[:-1] @ point[:-1] / 2 + (c * np.maximum(0, 1 - (2 * y - 1) * (x @ point[:-1] + point[-1]))).sum()

    best = objective(fit.point)
    assert 0 <= fit.gap <= 1e-3 * best + 1e-9 and fit.primal == pytest.approx(best)
    for _ in range(300):  # no other point found is below the bound
        assert objective(fit.point + rng.normal(size=p + 1) * 10 ** rng.uniform(-4, 0)) >= best - fit.gap - 1e-9


@pytest.mark.parametrize("alpha, l1_ratio", [(0.0, 0.0), (0.01, 0.5), (0.1, 1.0), (100.0, 1.0)])
def test_logistic_first_order_conditions(alpha, l1_ratio):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=500) > 0.3).astype(int)
    fit = local(B.Logistic(0, (), np.arange(6), alpha=alpha, l1_ratio=l1_ratio), x, y)
    w, b = fit.point[:-1], fit.point[-1]
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    g = x.T @ error / 500
    assert abs(error.mean()) < 1e-6
    for gj, wj in zip(g, w):
        if wj:
            assert abs(gj + alpha * (l1_ratio * np.sign(wj) + (1 - l1_ratio) * wj)) < 1e-6
        else:
            assert abs(gj) <= alpha * l1_ratio + 1e-6
    assert (w == 0).all() == (alpha == 100.0)


def test_missing_cells_fail_plainly(spark, table):
    with pytest.raises(ValueError, match="missing"):
        PL.fit_svm(table, FEATURES, "y")


def test_the_studys_grid_in_common_passes(spark, table, monkeypatch):
    """240 cells take no more passes than one: those of the slowest model."""
    passes = []
    real = B.total
    monkeypatch.setattr(B, "total", lambda *a: passes.append(1) or real(*a))
    assert len(PL.STUDY_GRID) == 240
    best, found = PL.search(table, "k", "y", FEATURES, PL.STUDY_GRID, k=2)
    rows = found.collect()
    assert len(rows) == 240 and all(r.n == 2 for r in rows) and max(r.score for r in rows) > 0.6
    assert found.where((F.col("alpha") == best["alpha"]) & (F.col("cost") == best["cost"])).agg(F.max("score")).first()[0] == max(r.score for r in rows)
    assert len(passes) < 150


def test_one_label_only(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(20)], "k int, y int, a double")
    model = PL.fit(df, "k", "y", ["a"], PL.cells()[0])
    assert model.transform(df, ["k"]).where("prob > 0.5").count() == 20


# --- keys

def test_text_keys_are_dealt_out(spark):
    df = spark.range(20_000).select(F.concat(F.lit("subject_with_a_long_name_"), F.format_string("%09d", "id")).alias("k"), (F.col("id") % 2).alias("y"))
    df = df.union(spark.createDataFrame([("A", 0), (None, 1)], "k string, y long")).cache()
    order = df.select("k", V._key_order(df, "k").alias("o"))
    sizes = order.groupBy("o").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 100 and sizes[1] > 2000
    rows = sorted((r.k or "", r.o) for r in order.collect())
    assert all(x[1] <= y[1] for x, y in zip(rows, rows[1:]))


def test_null_keys_take_part(spark):
    df = spark.createDataFrame([(None, 1), ("b", 0), ("a", 1)], "k string, y int")
    assert sorted(r.p for r in V.permute_labels(df, "k", "y", name="p").collect()) == [0, 1, 1]
    assert V.stratified_folds(df, "k", "y", 2, None).orderBy("y", F.col("k").asc_nulls_first()).select("k", "fold").collect() == [("b", 0), (None, 0), ("a", 1)]
    num = spark.createDataFrame([(None, 1), (5, 0), (-7, 1)], "k long, y int")
    assert V.permute_labels(num, "k", "y").count() == 3


# --- least squares

def test_aliased_terms_are_named(spark):
    rng = np.random.default_rng(6)
    x, g = rng.normal(1e6, 1, 300), rng.integers(0, 3, 300)
    y = 2 * x + g + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(3 - 2 * a), "uvw"[k], float(b)) for a, k, b in zip(x, g, y)], "x double, z double, g string, y double").repartition(4)
    table, stats = M.ols_fit(df, "y", ["x", "z", "C(g)"])
    got = {r.term: r for r in table.collect()}
    full = np.column_stack([np.ones(300), x - 1e6, g == 1, g == 2])
    want, rss, _, _ = np.linalg.lstsq(full, y, rcond=None)
    assert stats["rank"] == 4 and got["z"].coef is None and got["z"].p is None
    assert [got["x"].coef, got["C(g)[T.v]"].coef, got["C(g)[T.w]"].coef] == pytest.approx(list(want[1:]), rel=1e-6)
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss[0] / 296)
    assert [got["x"].se, got["C(g)[T.v]"].se] == pytest.approx(list(se[1:3]), rel=1e-6)
    table, stats = M.ols_fit(df.limit(2), "y", ["x"])
    assert stats["n"] == 2 and all(r.se is None or not math.isfinite(r.se) for r in table.collect())
    assert [r.coef for r in M.ols_fit(df.limit(0), "y", ["x"])[0].collect()] == [None, None]


def test_passes_read_blocks(spark, table, monkeypatch):
    """The rows are stored packed, one block a part here, and short sums of many parts need no shuffle."""
    monkeypatch.setattr(B, "ROWS_PER_TASK", 20)
    rows = B.Rows.of(table.withColumn("t", F.lit(7)), "y", FEATURES, ["t"])
    stored = rows.blocks.collect()
    assert len(stored) <= rows.parts < sum(r["n"] for r in stored) == table.count() and rows.parts > 8
    found = B.total(rows, 3, lambda y, t, x: np.array([y.sum(), t[:, 0].sum(), np.nansum(x)]))
    want = rows.df.agg(F.sum("_y"), F.sum("t"), sum(F.sum(f"_f{i}") for i in range(len(FEATURES)))).first()
    assert list(found) == pytest.approx(list(want))
    monkeypatch.setattr(B, "GATHERED", 0)
    assert list(B.total(rows, 3, lambda y, t, x: np.array([y.sum(), t[:, 0].sum(), np.nansum(x)]))) == pytest.approx(list(found))


@pytest.mark.parametrize("width", [2.0, 0.05])
def test_hinge_sums_by_class_equal_plain_ones(width):
    rng = np.random.default_rng(3)
    neg, pos = rng.normal(size=(2, 70)), rng.normal(size=(2, 30)) + 0.3
    fit = B.Hinge(0, (), np.arange(2), cost=0.7, counts=(70.0, 30.0), width=width)
    fit.at = np.array([0.4, -0.2, 0.1])
    x, side, c = np.vstack([np.hstack([neg, pos]), np.ones(100)]).T, np.repeat([-1.0, 1.0], [70, 30]), np.repeat([0.7 * 100 / 140, 0.7 * 100 / 60], [70, 30])
    u = 1 - side * (x @ fit.at)
    a, inside, hinge = c * np.clip(u / width, 0, 1), (u > 0) & (u < width), c * np.maximum(u, 0)
    rounded = c * np.where(u <= 0, 0, np.where(inside, u * u / (2 * width), u - width / 2))
    want = [[hinge.sum(), rounded.sum(), (hinge - a * u).sum(), a[70:].sum(), a[:70].sum()], pos @ a[70:], neg @ a[:70], (x[inside].T @ (x[inside] * (c[inside] / width)[:, None])).ravel()]
    assert list(fit.by_class(neg, pos)) == pytest.approx(list(np.concatenate(want)))


@pytest.fixture(scope="module")
def repeated(spark):
    """Keys that are NULL or come several times, each in one class."""
    rows = [(None if k == 7 else k, k % 3 and 1, float(i)) for i, k in enumerate([*range(60), 7, 5, 5, 12, 30, 31, 31])]
    return spark.createDataFrame(rows, "k long, y int, x double").repartition(3)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bin_rows", [5, 16_384])
def test_ranks_without_a_join_by_key(spark, repeated, monkeypatch, bin_rows):
    monkeypatch.setattr(V, "HASHED_ROWS", bin_rows)
    assert V.one_class_a_key(repeated, "k", ["y"])
    joined = V.null_safe_join(repeated, V.class_rank(repeated, "k", "y", 3).select("k", "rank", "class_n"), ["k"])
    was = sorted((str(r.k), r.x, r.rank) for r in joined.collect())
    assert sorted((str(r.k), r.x, r["rank"]) for r in V.with_class_rank(repeated, "k", ["y"], 3).collect()) == was
    split = V.with_splits(repeated, "k", "y", 0.3, [3, 4], lambda i: f"t{i}")
    assert sorted((str(r.k), r.x, r.t3) for r in split.collect()) == sorted((str(r.k), r.x, int(r["rank"] > math.floor(r.class_n * 0.3))) for r in joined.collect())
    tagged = PL._tagged(repeated, "k", "y", {"f": 4}, 2)
    assert {r.f for r in tagged.collect()} == {0, 1, 2, 3} and "__k" not in _plan(tagged) and "Join" not in _plan(split)


def test_keys_of_two_classes_meet_both_ranks(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "k long, y int")
    assert not V.one_class_a_key(df, "k", ["y"]) and PL._tagged(df, "k", "y", {"f": 2}, 2).count() == 6


def test_permuted_rows_are_dealt_out_once_a_side(spark, repeated):
    """The label at place r in hash order goes to the key at place r in key order."""
    got = V.permute_labels(repeated.where("k <> 5 and k <> 31 and k <> 12 and k <> 30"), "k", "y", seed=5, name="p")
    rows = got.collect()
    order = sorted((r for r in repeated.withColumn("h", V._hash(5, F.col("k"))).collect() if r.k not in (None, 5, 31, 12, 30)), key=lambda r: r.h)
    assert [r.p for r in sorted(rows, key=lambda r: r.k)] == [r.y for r in order]
    assert "__k#" not in _plan(got)


@pytest.mark.parametrize("cost", [0.1, 10.0])
def test_fits_start_from_picked_rows(spark, table, monkeypatch, cost):
    """A large table's SVM starts near its end, and ends by the gap over all rows."""
    many = PL.fit_imputer(table, FEATURES).transform(table).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20))))
    many = many.select("y", *[(F.col(c) + F.hash("k", "i", F.lit(c)) / 2.0 ** 33).alias(c) for c in FEATURES])
    plain = PL.fit_svm(many, FEATURES, "y", cost)
    monkeypatch.setattr(B, "START_ROWS", 500)
    monkeypatch.setattr(B, "PICKED", 2)
    rows = B.Rows.of(many, "y", FEATURES, [])
    sizes, at = [], rows
    while at is not None:
        sizes.append(sum(r.n for r in at.blocks.collect()))
        at = at.some
    assert sizes == [8000, 4000, 2000, 1000] or all(abs(a - 2 * b) <= 16 for a, b in zip(sizes, sizes[1:])) and len(sizes) == 4
    fast = PL.fit_svm(many, FEATURES, "y", cost)
    assert fast.gap <= 1e-3 and fast.passes < plain.passes / 2
    assert np.allclose(fast.weights, plain.weights, atol=0.05 * max(map(abs, plain.weights)))


@pytest.fixture
def large(spark, table, monkeypatch):
    """8000 rows that count as a large table, with a key each."""
    monkeypatch.setattr(B, "START_ROWS", 500)
    monkeypatch.setattr(B, "PICKED", 2)
    many = table.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return many.select((F.col("k") * 20 + F.col("i")).alias("k"), "y", *[(F.col(c) + F.hash("k", "i", F.lit(c)) / 2.0 ** 33).alias(c) for c in FEATURES]).cache()


def test_logistic_fits_start_from_picked_rows(spark, large, monkeypatch):
    """Selector and sigmoid of a large table take fewer passes over all its rows, to the same end."""
    rows = B.Rows.of(large, "y", FEATURES, [])
    prepared = [PL._as_arrays(*PL.prepare_all(rows, [()], PL.Settings())[0])]
    alone = B.Rows(rows.df, rows.features, rows.tags, rows.parts, rows.blocks)
    fits = [B.Logistic(0, (), np.arange(4), alpha=0.01, l1_ratio=0.5) for _ in range(2)]
    B.solve(rows, prepared, fits[:1])
    B.solve(alone, prepared, fits[1:])
    assert fits[0].passes < fits[1].passes and np.allclose(fits[0].point, fits[1].point, atol=1e-7)
    held = [[B.Scored(0, (), np.arange(4), np.array([0.5, 0.0, 0.4, 0.0, -0.2]))]]
    n = B.class_counts(rows, [()])
    passes, real = [], B.total
    monkeypatch.setattr(B, "total", lambda table, *a: passes.append(table.blocks is rows.blocks) or real(table, *a))
    one = B.sigmoids(rows, prepared, held, n)
    over_all = sum(passes)
    two = B.sigmoids(alone, prepared, held, n)
    assert one[0] == pytest.approx(two[0], rel=1e-7) and over_all < sum(passes) - over_all
    bad = B.Logistic(0, (), np.arange(4), alpha=0.01, l1_ratio=0.5)
    bad.at = bad.point = np.array([90.0, -90.0, 90.0, 90.0, -90.0])  # a start worse than none is left
    B.solve(alone, prepared, [bad])
    assert np.allclose(bad.point, fits[1].point, atol=1e-7)


def test_class_counts_read_no_features(spark, table, monkeypatch):
    rows = B.Rows.of(table.withColumn("t", (F.col("k") % 3).cast("int")), "y", FEATURES, ["t"])
    widths, real = [], B.total
    monkeypatch.setattr(B, "total", lambda rows, size, work, *a: widths.append(a) or real(rows, size, work, *a))
    subsets = [(), ((0, 1, True),), ((0, 1, False),)]
    want = [tuple(float(table.where(w).where(f"y = {k}").count()) for k in (0, 1)) for w in ("true", "k % 3 = 1", "k % 3 <> 1")]
    assert B.class_counts(rows, subsets) == want and widths == [(False,)]


def test_search_and_fit_share_their_rows(spark, table, monkeypatch):
    """One ranking and one stored table serve both, with the results of separate calls."""
    best, found = PL.search(table, "k", "y", FEATURES, PL.cells(), 3)
    alone = PL.fit(table, "k", "y", FEATURES, best)
    ranked, real = [], PL.with_class_rank
    monkeypatch.setattr(PL, "with_class_rank", lambda *a: ranked.append(1) or real(*a))
    rows = PL.laid(table, "k", "y", FEATURES, 3)
    again, shared = PL.search(table, "k", "y", FEATURES, PL.cells(), 3, rows=rows)
    model = PL.fit(table, "k", "y", FEATURES, again, rows=rows)
    assert len(ranked) == 1 and again == best
    assert [list(r)[:3] + [round(r.score, 9), r.n] for r in shared.collect()] == [list(r)[:3] + [round(r.score, 9), r.n] for r in found.collect()]
    assert model.selector.names == alone.selector.names and model.selector.scores == pytest.approx(alone.selector.scores, rel=1e-9)
    assert [*model.svm.weights, model.svm.a, model.svm.b] == pytest.approx([*alone.svm.weights, alone.svm.a, alone.svm.b], rel=1e-6)
    split = table.select("k", "y", *FEATURES).union(table.select("k", 1 - F.col("y"), *FEATURES).limit(3))
    assert PL.laid(split, "k", "y", FEATURES, 3) is None


def test_held_out_rows_alone_are_scored(spark, table, monkeypatch):
    """A single cell lays no inner folds; rows get the model of their own fold without a join, training rows when asked for."""
    scored, joined, tags = [], [], []
    real, of = B.scored, B.Rows.of
    monkeypatch.setattr(PL.B, "scored", lambda rows, prepared, models, keep=(): scored.append([m.subset for m in models]) or real(rows, prepared, models, keep))
    monkeypatch.setattr(PL, "null_safe_join", lambda *a: joined.append(1))
    monkeypatch.setattr(PL.B.Rows, "of", staticmethod(lambda df, label, features, t, keep=(): tags.extend(t) or of(df, label, features, t, keep)))
    found = PL.nested(table, "k", "y", FEATURES, PL.cells(costs=(1.0,)), outer_k=3)
    assert scored == [[((0, f, True),) for f in range(3)]] and not joined and tags == ["_outer", "_p"]
    oof = found.oof.collect()
    assert sorted(r.k for r in oof) == list(range(400)) and {r.fold for r in oof} == {0, 1, 2}
    for f, model in enumerate(found.models):
        of_model = {r.k: r.prob for r in model.transform(table, ["k"]).collect()}
        assert all(r.prob == pytest.approx(of_model[r.k], abs=1e-9) for r in oof if r.fold == f)
    assert found.scores.count() == 54 and len(scored) == 2


def test_repeated_keys_meet_each_others_folds(spark, table):
    """Rows of one key stay together; each is listed once a row of its key, as before."""
    twice = table.union(table.where("k < 10"))
    found = PL.nested(twice, "k", "y", FEATURES, PL.cells(costs=(1.0,)), outer_k=3)
    counts = {r.k: r["count"] for r in found.oof.groupBy("k").count().collect()}
    assert counts == {k: 4 if k < 10 else 1 for k in range(400)} and found.scores.count() == 54
