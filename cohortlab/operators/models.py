"""Regression with inference, mean imputation, scaling and the elastic-net
selection as tables (R2-R4, M1-M3, M5).

``GeneralizedLinearRegression`` solves the logistic model through a distributed
Gramian (one aggregate an iteration); least squares come from a QR factor
merged in a tree. Result tables are built from a few numbers per term.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from .design import design_matrix
from .pipeline import fit_selector
from .ranks import fdr_bh
from .separation import independent_columns, separated_terms

# Executors need not have this module: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Z975 = 1.959963984540054  # standard normal 97.5 % quantile (fixed value)


def assemble(df: DataFrame, cols: list[str], out: str = "features", keep_invalid: bool = True) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out,
                           handleInvalid="keep" if keep_invalid else "skip").transform(df)


def split_xy(df: DataFrame, features: list[str], label: str, key: str | None = None,
             dropna: bool = False) -> DataFrame:
    """Feature matrix + label as one frame: ``(key, features vector,
    label double)``; NULL features are kept as NaN unless ``dropna``."""
    src = df.na.drop("any", subset=[*features, label]) if dropna else df
    out = assemble(src, features, "features", keep_invalid=not dropna)
    return out.select(*([key] if key else []), "features", F.col(label).cast("double").alias("label"))


def logit_fit(df: DataFrame, label: str, terms: list[str], max_iter: int = 100,
              tol: float = 1e-10) -> tuple[DataFrame, dict]:
    """R2: logistic regression with Wald inference. Complete cases only.

    Returns ``(table, stats)``: table rows ``(term, coef, se, z, p, lo, hi,
    status)`` with the intercept first; stats ``llf, aic, n, k``. The label is 0 or 1.

    ``status`` is 'estimated'; 'separated' for a term whose estimate is not
    finite (``separation``); 'aliased' for a combination of earlier terms. The
    last two keep their row with NULL statistics. The others are estimated on the
    rows that no direction of recession separates, which is the limit of the fit:
    separated rows reach likelihood one. k counts all terms but the aliased ones.
    """
    X, safe, names = design_matrix(df, terms, keep=[label])
    # Every pass of the search and of IRLS reads the rows: keep the (small) design
    # rows cached instead of re-deriving them from the source each time.
    X = X.na.drop("any").select(*[F.col(c).cast("double") for c in [*safe, label]]).persist()
    try:
        r, n_obs = triangular_factor(X, [*safe, label])
        r = r[:, :-1]
        used, basis = independent_columns(r, ALIASED) if n_obs else ([], r)
        cols = [safe[j - 1] for j in used[1:]]
        status = dict.fromkeys(range(len(safe) + 1), "aliased")
        found, ll = {}, 0.0
        if used:
            factor = lambda rows: triangular_factor(rows, [*cols, label])[0][:, :-1]
            apart, rest = separated_terms(X.select(*cols, label), cols, basis.T @ r[:, used], factor)
            status.update({used[i]: "separated" if i in apart else "estimated" for i in range(len(used))})
            kept = used
            if apart:
                whole = factor(rest)
                # Rows may be left where only combinations of separated terms can be told apart.
                some = independent_columns(whole, ALIASED)[0] if np.abs(whole).max(initial=0.0) > 0 else []
                kept = [used[i] for i in some]
            if kept:
                found, ll = _irls(rest, [safe[j - 1] for j in kept[1:]], label, kept, max_iter, tol)
    finally:
        X.unpersist()
    rows = [(t, *(found[j] if j in found and status[j] == "estimated" else [None] * 6), status[j])
            for j, t in enumerate(["Intercept", *names])]
    k = len(used)
    table = df.sparkSession.createDataFrame(
        rows, "term string, coef double, se double, z double, p double, lo double, hi double, status string")
    return table, {"llf": ll, "aic": 2.0 * k - 2.0 * ll, "n": n_obs, "k": k}


def _irls(X: DataFrame, cols: list[str], label: str, places: list[int], max_iter: int, tol: float) -> tuple[dict, float]:
    """Estimates by place (coef, se, z, p, lo, hi) and the log-likelihood."""
    if not cols:
        # Without columns the fit is the share of ones.
        n, ones = X.agg(F.count(F.lit(1)), F.sum(label)).first()
        share = ones / n
        b, e = math.log(share / (1 - share)), 1 / math.sqrt(n * share * (1 - share))
        p = math.erfc(abs(b / e) / math.sqrt(2))
        return {places[0]: (b, e, b / e, p, b - Z975 * e, b + Z975 * e)}, ones * math.log(share) + (n - ones) * math.log(1 - share)
    data = assemble(X, cols).select(F.col(label).alias("label"), "features")
    glr = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter, tol=tol,
                                      fitIntercept=True, featuresCol="features", labelCol="label")
    m = glr.fit(data)
    s = m.summary
    ses, pvs, aic = list(s.coefficientStandardErrors), list(s.pValues), float(s.aic)
    coefs = [m.intercept] + list(m.coefficients)
    se = [ses[-1]] + ses[:-1]
    pv = [pvs[-1]] + pvs[:-1]
    found = {j: (float(b), float(e), float(b / e) if e else float("nan"), float(p), float(b - Z975 * e), float(b + Z975 * e))
             for j, b, e, p in zip(places, coefs, se, pv)}
    return found, (2.0 * len(coefs) - aic) / 2.0


def logit_odds_ratios(table: DataFrame, digits: int = 4) -> DataFrame:
    """Coefficient table with BH-adjusted p, odds ratio and its 95 % CI."""
    t = fdr_bh(table, "p", order_tie=["term"], out="p_fdr")
    return t.select("term", F.bround("coef", digits).alias("coef"), F.bround("p", digits).alias("p"),
                    F.bround("p_fdr", digits).alias("p_fdr"),
                    F.bround(F.exp("coef"), digits).alias("odds_ratio"),
                    F.bround(F.exp("lo"), digits).alias("ci_lo"),
                    F.bround(F.exp("hi"), digits).alias("ci_hi"))


# A column is aliased if what earlier columns leave of it is below this share of its length.
ALIASED = 1e-9
# Triangular factors one task merges.
FAN_IN = 64


def triangular_factor(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """R of the QR decomposition of (1, cols) over all rows, and the number of
    rows: factors of blocks are merged in a tree, so no product of the columns
    is taken and precision is that of the data, not of its square."""
    k = len(cols) + 1

    def pack(r: np.ndarray, n: int, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "n", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, k)), 0
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            r, n = np.linalg.qr(np.vstack([r, x]), mode="r"), n + len(x)
        yield pack(r, n, TaskContext.get().partitionId())

    def merged(ns: list[int], rs: list[bytes]) -> tuple[np.ndarray, int]:
        return np.linalg.qr(np.vstack([np.zeros((1, k)), *[np.frombuffer(r).reshape(-1, k) for r in rs]]), mode="r"), sum(ns)

    def merge(table: pa.Table) -> pa.Table:
        r, n = merged(table.column("n").to_pylist(), table.column("r").to_pylist())
        return pa.Table.from_batches([pack(r, n, min(table.column("part").to_pylist()))])

    data = df.select(*[F.col(c).cast("double") for c in cols])
    parts, found = data.rdd.getNumPartitions(), data.mapInArrow(run, "part long, n long, r binary")
    while parts > 8:
        parts = -(-parts // FAN_IN)
        found = found.groupBy((F.col("part") % parts).alias("_g")).applyInArrow(merge, "part long, n long, r binary")
    rows = sorted(found.collect())
    return merged([r["n"] for r in rows], [bytes(r["r"]) for r in rows])


def ols_fit(df: DataFrame, label: str, terms: list[str]) -> tuple[DataFrame, dict]:
    """Ordinary least squares with t-based inference, from a QR factor.

    Complete cases only. A term that is a linear combination of the terms
    before it is aliased: it keeps its row, with NULL statistics, and the model
    is that of the other terms. Returns ``(table (term, coef, se, t, p), stats
    r2, n, rank)``.
    """
    X, safe, names = design_matrix(df, terms, keep=[label])
    X = X.na.drop("any")
    r, n = triangular_factor(X, [*safe, label])
    r = np.vstack([r, np.zeros((max(0, len(safe) + 2 - len(r)), len(safe) + 2))])
    y = r[:, -1]
    used, basis = independent_columns(r[:, :-1], ALIASED)
    upper = basis.T @ r[:, used]
    coef = np.linalg.solve(upper, basis.T @ y) if used else np.zeros(0)
    left = y - basis @ (basis.T @ y)
    rss, free = float(left @ left), n - len(used)
    one = basis[:, :1] if used else np.zeros((len(r), 0))
    centred = y - one @ (one.T @ y)
    tss = float(centred @ centred)
    inverse = np.linalg.inv(upper) if used else np.zeros((0, 0))
    se = np.sqrt((inverse * inverse).sum(axis=1) * rss / free) if free > 0 else np.full(len(used), np.nan)
    number = lambda v: None if not np.isfinite(v) else float(v)
    found = {j: (float(b), number(e), number(b / e) if e > 0 else None) for j, b, e in zip(used, coef, se)}
    rows = [(i, t, *found.get(i, (None, None, None)), float(max(free, 1))) for i, t in enumerate(["Intercept", *names])]
    table = df.sparkSession.createDataFrame(rows, "_i int, term string, coef double, se double, t double, _free double")
    table = table.withColumn("p", F.when(F.col("t").isNotNull(), D.t_sf_two_sided("t", "_free"))).orderBy("_i").drop("_i", "_free")
    return table, {"r2": 1 - rss / tss if tss > 0 else None, "n": n, "rank": len(used)}


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1 (cheap form): replace NULL by the column mean (``ml.feature.Imputer``)."""
    tmp = [f"_imp_{i}" for i in range(len(cols))]
    model = Imputer(strategy="mean", inputCols=cols, outputCols=tmp).fit(df)
    out = model.transform(df)
    rename = dict(zip(cols, tmp))
    return out.select(*[F.col(rename[c]).alias(c) if c in rename else F.col(c) for c in df.columns])


def scale_features(df: DataFrame, cols: list[str], ddof: int = 1, keep: list[str] | None = None) -> DataFrame:
    """M2: centre and scale by the standard deviation (``ml.feature.StandardScaler``,
    which divides by the sample sd; ``ddof=0`` rescales to the population sd
    as scikit-learn does). Statistics come from the frame it is fitted on."""
    data = assemble(df, cols, "_x")
    model = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_z").fit(data)
    z = model.transform(data).withColumn("_za", vector_to_array("_z"))
    if ddof == 0:
        n = df.count()
        factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    else:
        factor = 1.0
    return z.select(*(keep or []), *[(F.col("_za")[i] * factor).alias(c) for i, c in enumerate(cols)])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M5 helper: 'balanced' weights N / (n_classes * n_class) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    return c.select(label, "n_class",
                    (F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class"))).alias("weight"))


def select_elastic_net(df: DataFrame, features: list[str], label: str, reg: float = 0.01,
                       l1_ratio: float = 0.5, threshold: float = 1e-5) -> DataFrame:
    """M3: the pipeline's elastic-net selector on standardised features; keep
    features with |coef| > threshold (threshold -inf keeps all, as the reference)."""
    z = scale_features(df.where(F.col(label).isNotNull()), features, ddof=0, keep=[label])
    scores = fit_selector(z, features, label, "elastic_net", reg, l1_ratio, threshold).scores
    rows = [(f, scores[f], bool(abs(scores[f]) > threshold)) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, coef double, selected boolean")


def classifier_pipeline(features: list[str], label: str, reg: float = 0.01, l1_ratio: float = 0.0,
                        impute: bool = True) -> Pipeline:
    """M6: impute -> assemble -> scale -> elastic-net logistic classifier.
    Every stage is an Estimator, so fitting on training rows only keeps the
    held-out rows out of every statistic (no leakage)."""
    tmp = [f"_i_{i}" for i in range(len(features))]
    stages = []
    cols = features
    if impute:
        stages.append(Imputer(strategy="mean", inputCols=features, outputCols=tmp))
        cols = tmp
    stages += [VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep"),
               StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="features"),
               LogisticRegression(featuresCol="features", labelCol=label, regParam=reg,
                                  elasticNetParam=l1_ratio, maxIter=100)]
    return Pipeline(stages=stages)


def positive_prob(df: DataFrame, col: str = "probability", out: str = "prob") -> DataFrame:
    return df.withColumn(out, vector_to_array(col)[1])
