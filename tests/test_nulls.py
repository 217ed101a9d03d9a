"""The null of the AUC drawn from counts: draws against numpy and closed forms."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import nulls as N
from cohortlab.operators import validate as V


def test_large_populations_follow_the_same_law():
    rng = np.random.default_rng(1)
    ours = np.array([N.large_hypergeometric(60, 90, 40, u) for u in rng.random(20000)])
    theirs = rng.hypergeometric(60, 90, 40, 20000)
    for k in range(10, 23):
        assert abs((ours <= k).mean() - (theirs <= k).mean()) < 0.02
    big = np.array([N.large_hypergeometric(3 * 10 ** 9, 5 * 10 ** 9, 10 ** 6, u) for u in rng.random(300)])
    assert abs(big.mean() - 375000) < 5 * (10 ** 6 * 15 / 64 / 300) ** 0.5
    assert N.large_hypergeometric(0, 5, 3, 0.5) == 0 and N.large_hypergeometric(5, 0, 3, 0.5) == 3
    assert N.large_hypergeometric(5, 5, 10, 0.99) == 5 and N.large_hypergeometric(7, 2, 0, 0.1) == 0


def test_deal_keeps_the_totals_and_the_law():
    sizes = np.array([5, 0, 7, 1, 12], np.int64)
    drawn = N.deal(np.random.default_rng(3), sizes, np.full(20000, 9))
    assert (drawn.sum(axis=1) == 9).all() and (drawn <= sizes).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(axis=0), 9 * sizes / 25, atol=0.05)
    covariance = -9 * (16 / 24) * sizes[0] * sizes[4] / 25 ** 2
    assert abs(np.cov(drawn[:, 0], drawn[:, 4])[0, 1] - covariance) < 0.05
    assert N.deal(np.random.default_rng(3), np.array([4]), np.array([2, 0])).tolist() == [[2], [0]]


def test_every_arrangement_is_equally_likely(spark):
    scores = [0.1, 0.2, 0.2, 0.5, 0.9]
    rows = [(s, int(i in (1, 4))) for i, s in enumerate(scores)]
    mid = {s: sorted(scores).index(s) + (scores.count(s) + 1) / 2 for s in scores}
    law: dict[float, float] = {}
    for pick in combinations(scores, 2):
        auc = round((sum(mid[s] for s in pick) - 3) / 6, 6)
        law[auc] = law.get(auc, 0) + 0.1
    got = N.null_auc_from_counts(spark.createDataFrame(rows, "s double, y int"), "y", "s", 4000, seed=5).toPandas()
    assert sorted(got.perm) == list(range(4000))
    seen = got.auc.round(6).value_counts(normalize=True).to_dict()
    assert set(seen) == set(law)
    assert all(abs(seen[a] - law[a]) < 5 * (law[a] / 4000) ** 0.5 for a in law)


def test_blocks_and_chunks(spark, monkeypatch):
    df = spark.range(900).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(300)) / 300).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    variance = N.null_variance(df, "y", "s").first()["variance"]
    for name, value in (("BLOCK_SCORES", 32), ("MAX_BLOCKS", 16), ("CHUNK", 64), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(N, name, value)
        null = N.null_auc_from_counts(df, "y", "s", 2000, seed=9).toPandas()
        assert sorted(null.perm) == list(range(2000))
        assert abs(null.auc.mean() - 0.5) < 5 * (variance / 2000) ** 0.5
        assert abs(null.auc.var() / variance - 1) < 5 * (2 / 2000) ** 0.5
    again = N.null_auc_from_counts(df.repartition(7), "y", "s", 2000, seed=9).toPandas()
    assert dict(zip(again.perm, again.auc)) == dict(zip(null.perm, null.auc))


def test_missing_values_and_one_class(spark):
    rows = [(0.1, 1), (None, 1), (0.4, None), (float("nan"), 0), (0.4, 0), (0.4, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert {round(r.auc, 6) for r in N.null_auc_from_counts(df, "y", "s", 50).collect()} <= {0.0, 0.75}
    for one in (df.where("y = 0"), df.where("false")):
        assert [r.auc for r in N.null_auc_from_counts(one, "y", "s", 3).collect()] == [None] * 3
    keys = V.permutation_test(df.withColumn("k", F.monotonically_increasing_id()), "k", "y", "s", 0.0, 20)
    assert keys.first()["p_value"] == 1.0
    with pytest.raises(ValueError):
        V.permutation_test(df, "k", "y", "s", 0.0, 20, draw="rows")
