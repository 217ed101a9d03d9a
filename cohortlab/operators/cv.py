"""The permutation test that refits the pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import batch as B
from . import pipeline as PL
from .ranks import null_safe_join
from .validate import METRICS, class_rank, classification_metrics, one_class_a_key, perm_pvalue, permute_labels, with_splits

# Permutations whose pipelines are fitted in the same passes.
AT_ONCE = 20


def permutation_test_refit(df: DataFrame, key: str, label: str, features: list[str], true_score: float,
                           n_permutations: int = 100, train_size: float = 0.1, cell: dict | None = None,
                           metric: str = "accuracy", s: PL.Settings = PL.Settings()) -> DataFrame:
    """M11 mode (a), the reference's procedure: for permutation i, a
    stratified split (``train_size`` of each class for training, seed i), a fit
    of the four-stage pipeline on the training rows, and the score (decisions
    at margin 0) on the test rows against permuted test labels. Exactly
    ``n_permutations`` fits, ``AT_ONCE`` in the same passes; p = (k + 1) / (n + 1)
    with k null scores >= the true score. Rows with a NULL label take no part.
    For large n the scale mode is ``validate.permutation_test``.
    Returns one row ``(n_exceed, n_null, p_value, true_score)``.
    """
    if metric not in METRICS or metric == "brier":
        raise ValueError(metric)
    cell = cell or PL.cells()[-1]
    base = cut_lineage(df.where(F.col(label).isNotNull()).select(key, label, *features))
    scores, plain = [], one_class_a_key(base, key, [label])
    for first in range(0, n_permutations, AT_ONCE):
        seeds, data = range(first, min(first + AT_ONCE, n_permutations)), base
        if plain:
            data = with_splits(base, key, label, train_size, [*seeds], lambda i: f"_t{i}")
        for i in () if plain else seeds:
            ranked = class_rank(base, key, label, i)
            data = null_safe_join(data, ranked.select(key, (F.col("rank") > F.floor(F.col("class_n") * train_size)).cast("int").alias(f"_t{i}")), [key])
        rows = B.Rows.of(data, label, features, [f"_t{i}" for i in seeds], keep=[key])
        models, prepared, which = PL.fit_many(rows, [(((k, 0, True),), cell) for k in range(len(seeds))], s, None)
        place = {c: i for i, c in enumerate(features)}
        tests = [B.Scored(which[k], ((k, 1, True),), np.array([place[c] for c in m.svm.columns]), np.array([*m.svm.weights, m.svm.intercept])) for k, m in enumerate(models)]
        found = cut_lineage(B.scored(rows, prepared, tests, [key]))
        # Written, as the metrics read it more than once.
        permuted = cut_lineage(permute_labels(found, key, "_y", seed=first, name="_perm", by=["part"]).select("part", "_perm", "score"))
        table = classification_metrics(permuted, "_perm", "score", ["part"], threshold=0.0)
        scores += [(first + r["part"], None if r[metric] is None else float(r[metric])) for r in table.select("part", metric).collect()]
    null = df.sparkSession.createDataFrame(scores, "perm int, score double")
    return perm_pvalue(null, "score", true_score).withColumn("true_score", F.lit(float(true_score)))
