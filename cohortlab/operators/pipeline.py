"""The leak-free classifier pipeline (M1-M8, M10, M13, S7): chained imputation,
scaling, feature selection, balanced linear SVM with calibrated probabilities.

Every stage is fitted on the rows it is given and becomes a small object of
numbers; ``transform`` is column expressions only, so a fitted pipeline scores
any frame in one pass, and held-out rows can reach no statistic. All folds and
grid cells of a search are fitted in common passes (``batch``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import batch as B
from .ranks import null_safe_join, present
from .validate import METRICS, class_rank, classification_metrics, key_kinds, metrics_long, one_class_a_key, with_class_rank

# Targets whose sums of products one aggregate takes.
TARGETS_PER_PASS = 4
# Rows of one part of a compact table.
ROWS_PER_PART = 50_000


def compact(df: DataFrame) -> DataFrame:
    """The frame written once, in as many parts as its rows need."""
    table = cut_lineage(df)
    return table.coalesce(max(1, -(-table.count() // ROWS_PER_PART)))


# ------------------------------------------------------------------ imputer
@dataclass
class Regression:
    """One column's prediction from others: intercept + sum of coefs * columns."""

    target: int
    predictors: list[int]
    coefs: list[float]
    intercept: float


@dataclass
class Imputer:
    """M1: a fitted chained imputer. Missing cells (NULL or NaN) start at the
    column's mean and are predicted anew in each round, all from the round
    before; observed cells never change."""

    columns: list[str]
    means: list[float]
    rounds: list[list[Regression]] = field(default_factory=list)
    low: float = -5000.0
    high: float = 5000.0

    def start(self, df: DataFrame) -> DataFrame:
        seen = [F.when(present(df, c), F.col(c).cast("double")) for c in self.columns]
        return df.withColumns({f"_o{i}": x for i, x in enumerate(seen)} | {f"_x{i}": F.coalesce(x, F.lit(m)) for i, (x, m) in enumerate(zip(seen, self.means))})

    def step(self, df: DataFrame, models: list[Regression]) -> DataFrame:
        new = {}
        for m in models:
            guess = F.lit(m.intercept)
            for j, b in zip(m.predictors, m.coefs):
                guess = guess + F.lit(b) * F.col(f"_x{j}")
            new[f"_x{m.target}"] = F.coalesce(F.col(f"_o{m.target}"), F.least(F.greatest(guess, F.lit(self.low)), F.lit(self.high)))
        return df.withColumns(new) if new else df

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns filled, as doubles."""
        out = self.start(df)
        for models in self.rounds:
            out = self.step(out, models)
        out = out.withColumns({c: F.col(f"_x{i}") for i, c in enumerate(self.columns)})
        return out.drop(*[f"_{k}{i}" for k in "ox" for i in range(len(self.columns))])


def fit_imputer(df: DataFrame, columns: list[str], rounds: int = 3, n_nearest: int = 10, reg: float = 1e-3,
                low: float = -5000.0, high: float = 5000.0) -> Imputer:
    """M1: fit by ridge regression of each column with gaps on its ``n_nearest``
    most correlated columns, over the rows where it was observed.

    A column without any observed value has the mean 0 and no regression. The
    moments of each missingness pattern give all rounds at once; where a
    prediction could reach ``low`` or ``high``, or there are very many
    patterns, the rows are read in each round (``fit_imputer_by_rows``).
    """
    rows = B.Rows.of(df.select(F.lit(0).alias("_l"), *columns), "_l", columns, [])
    s = Settings(rounds=rounds, n_nearest=n_nearest)
    return prepare_all(rows, [()], s, reg, low, high)[0][0]


def fit_imputer_by_rows(df: DataFrame, columns: list[str], rounds: int = 3, n_nearest: int = 10, reg: float = 1e-3,
                        low: float = -5000.0, high: float = 5000.0) -> Imputer:
    """``fit_imputer`` from the rows: one aggregate gives means, one the
    correlations of the mean-filled frame, and each round sums products for
    ``TARGETS_PER_PASS`` columns at once; the frame is written after each round."""
    seen = {c: F.when(present(df, c), F.col(c).cast("double")) for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(seen.values()) for k, f in (("c", F.count), ("m", F.avg))]).first()
    out = Imputer(list(columns), [float(row[f"m{i}"] or 0.0) for i in range(len(columns))], [], low, high)
    gaps = sorted((i for i in range(len(columns)) if 0 < row[f"c{i}"] < row["n"]), key=lambda i: (row["n"] - row[f"c{i}"], columns[i]))
    if not gaps or rounds < 1:
        return out
    cur = cut_lineage(out.start(df.select(*columns)).select(*[f"_{k}{i}" for i in range(len(columns)) for k in "ox"]))
    near = _nearest(cur, gaps, len(columns), n_nearest)
    for _ in range(rounds):
        models = []
        for at in range(0, len(gaps), TARGETS_PER_PASS):
            models += _regressions(cur, gaps[at:at + TARGETS_PER_PASS], near, reg)
        out.rounds.append(models)
        cur = cut_lineage(out.step(cur, models))
    return out


def _nearest(cur: DataFrame, gaps: list[int], k: int, n_nearest: int) -> dict[int, list[int]]:
    """The columns most correlated with each column that has gaps (ties: first)."""
    near = {}
    for t in gaps:
        others = [j for j in range(k) if j != t]
        row = cur.agg(*[F.try_divide(F.covar_pop(f"_x{j}", f"_x{t}"), F.stddev_pop(f"_x{j}") * F.stddev_pop(f"_x{t}")).alias(f"r{j}") for j in others]).first()
        near[t] = sorted(others, key=lambda j: (-abs(row[f"r{j}"] or 0.0), j))[:n_nearest]
    return near


def _regressions(cur: DataFrame, targets: list[int], near: dict[int, list[int]], reg: float) -> list[Regression]:
    """Ridge regressions of some targets, from one pass for the moments and one for the products of deviations."""
    moments = []
    for t in targets:
        seen = F.col(f"_o{t}").isNotNull()
        moments += [f(F.when(seen, F.col(f"_x{j}"))).alias(f"{k}{t}_{j}") for j in [*near[t], t] for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    m = cur.agg(*moments).first()
    sums = []
    for t in targets:
        dev = {j: F.when(F.col(f"_o{t}").isNotNull(), (F.col(f"_x{j}") - m[f"m{t}_{j}"]) / (m[f"s{t}_{j}"] or 1.0)) for j in [*near[t], t]}
        sums += [F.avg(dev[a] * dev[b]).alias(f"p{t}_{a}_{b}") for a, b in itertools.combinations_with_replacement(near[t], 2)]
        sums += [F.avg(dev[a] * dev[t]).alias(f"y{t}_{a}") for a in near[t]]
    p = cur.agg(*sums).first()
    out = []
    for t in targets:
        js = near[t]
        g = np.array([[p[f"p{t}_{min(a, b, key=js.index)}_{max(a, b, key=js.index)}"] for b in js] for a in js])
        y = np.array([p[f"y{t}_{a}"] for a in js])
        b = np.linalg.solve(g + reg * np.eye(len(js)), y) if js else np.zeros(0)
        b = b * (m[f"s{t}_{t}"] or 0.0) / np.array([m[f"s{t}_{j}"] or 1.0 for j in js])
        out.append(Regression(t, js, [float(x) for x in b], float(m[f"m{t}_{t}"] - sum(x * m[f"m{t}_{j}"] for x, j in zip(b, js)))))
    return out


# ------------------------------------------------------------------- scaler
@dataclass
class Scaler:
    """M2: (x - mean) / sd with the population sd; a constant column keeps the divisor 1."""

    columns: list[str]
    means: list[float]
    sds: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.means, self.sds)})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, sds = ([float(row[f"{k}{i}"] or 0.0) for i in range(len(columns))] for k in "ms")
    # A deviation that is only the rounding of the mean is none.
    return Scaler(list(columns), means, [s if s > 1e-12 * abs(m) else 1.0 for m, s in zip(means, sds)])


# ----------------------------------------------------------------- selector
@dataclass
class Selector:
    """M3, M4: the chosen columns, and a coefficient or F score for every column."""

    kind: str
    names: list[str]
    scores: dict[str, float]
    intercept: float = 0.0


def _selectors(rows: B.Rows, prepared: list[B.Prepared], wanted: list[tuple[int, B.Subset, float, float]], s: Settings) -> list[Selector]:
    """A selector for each (prepared, subset, alpha, l1_ratio)."""
    columns, every = rows.features, np.arange(len(rows.features))
    if s.selector is None:
        return [Selector("none", list(columns), {}) for _ in wanted]
    if s.selector == "f_test":
        out = []
        for f in B.f_scores(rows, prepared, [w[:2] for w in wanted]):
            scores = dict(zip(columns, map(float, f)))
            top = set(sorted(columns, key=lambda c: (-scores[c], c))[:s.k])
            out.append(Selector("f_test", [c for c in columns if c in top], scores))
        return out
    if s.selector != "elastic_net":
        raise ValueError(s.selector)
    fits = [B.Logistic(f, subset, every, alpha=a, l1_ratio=r) for f, subset, a, r in wanted]
    B.solve(rows, prepared, fits)
    out = []
    for fit_ in fits:
        scores = dict(zip(columns, map(float, fit_.point[:-1])))
        out.append(Selector("elastic_net", [c for c in columns if abs(scores[c]) > s.threshold] or [max(columns, key=lambda c: (abs(scores[c]), c))], scores, float(fit_.point[-1])))
    return out


def _plain(columns: list[str]) -> B.Prepared:
    """Columns as they are; a missing cell makes the fit fail."""
    k = len(columns)
    return B.Prepared(np.full(k, np.nan), [], -np.inf, np.inf, np.zeros(k), np.ones(k))


def fit_selector(df: DataFrame, columns: list[str], label: str, kind: str | None = "elastic_net", alpha: float = 0.01,
                 l1_ratio: float = 0.5, threshold: float = 1e-5, k: int = 10) -> Selector:
    """``elastic_net``: columns whose logistic coefficient exceeds the threshold
    (the greatest one if none does); ``f_test``: the k greatest ANOVA F (ties
    by name); None: all."""
    rows = B.Rows.of(df.where(F.col(label).isNotNull()), label, columns, [])
    return _selectors(rows, [_plain(columns)], [(0, (), alpha, l1_ratio)], Settings(selector=kind, threshold=threshold, k=k))[0]


# ---------------------------------------------------------------------- SVM
@dataclass
class Svm:
    """M5: margin = weights * x + intercept, probability = 1 / (1 + exp(-(a * margin + b))).

    ``gap`` is a proven bound on how far the objective is above the least one,
    as a share of it, after ``passes`` passes over the rows; the dual weights behind
    it are c * min(max(1 - y * margin, 0) / ``width``, 1)."""

    columns: list[str]
    weights: list[float]
    intercept: float
    a: float = 1.0
    b: float = 0.0
    gap: float = 0.0
    width: float = 1.0
    passes: int = 0

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            out = out + F.lit(w) * F.col(c)
        return out

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-(F.lit(self.a) * self.margin() + F.lit(self.b))))


@dataclass
class Want:
    """An SVM to be fitted: on the prepared rows of a subset, with some columns."""

    prepared: int
    subset: B.Subset
    names: list[str]
    cost: float


def _svms(rows: B.Rows, prepared: list[B.Prepared], wanted: list[Want], s: Settings, platt: int | None) -> list[Svm]:
    """All SVMs in common passes. ``platt`` is the tag of calibration folds: then
    each SVM has a sigmoid of the margins of rows that the SVM behind them had not seen."""
    place = {c: i for i, c in enumerate(rows.features)}
    folds = range(s.platt_folds) if platt is not None else ()
    at = [(w, part) for w in wanted for part in [w.subset, *[(*w.subset, (platt, f, False)) for f in folds]]]
    subsets = list(dict.fromkeys(part for _, part in at))
    counts = dict(zip(subsets, B.class_counts(rows, subsets)))
    fits = [B.Hinge(w.prepared, part, np.array([place[c] for c in w.names]), cost=w.cost, counts=counts[part], tol=s.tol) for w, part in at]
    for f in fits:
        if min(f.counts) == 0:  # one label only: nothing to tell apart, every row gets its side
            f.point, f.gap, f.primal, f.done = np.append(np.zeros(len(f.cols)), 1.0 if f.counts[1] else -1.0), 0.0, 0.0, True
    B.solve(rows, prepared, fits)
    out, step = [], 1 + len(folds)
    for i, w in enumerate(wanted):
        f = fits[i * step]
        out.append(Svm(list(w.names), [float(x) for x in f.point[:-1]], float(f.point[-1]), gap=float(max(f.gap, 0.0) / max(f.primal, 1e-300)), width=f.width, passes=f.passes))
    if platt is not None:
        held = [[B.Scored(w.prepared, (*w.subset, (platt, k, True)), fits[i * step + 1 + k].cols, fits[i * step + 1 + k].point) for k in folds] for i, w in enumerate(wanted)]
        for svm, (a, b) in zip(out, B.sigmoids(rows, prepared, held, [counts[w.subset] for w in wanted])):
            svm.a, svm.b = a, b
    return out


def _tagged(df: DataFrame, key: str, label: str, folds: dict[str, int | tuple[int, int]], seed: int, within: list[str] = (),
            plain: bool | None = None) -> DataFrame:
    """Fold numbers by hash order of the keys, classes spread evenly within each combination of the columns ``within``.

    ``folds`` are numbers of folds, or (folds, order): folds of the same order share one ranking, else each has the
    order of its place. Where a key has rows of several classes (not ``plain``), each of its rows meets each of the key's ranks."""
    if plain is None:
        plain = one_class_a_key(df, key, [*within, label])
    orders = {}
    for i, (name, f) in enumerate(folds.items()):
        k, order = f if isinstance(f, tuple) else (f, i)
        orders.setdefault(order, {})[name] = k
    for order, named in orders.items():
        if plain:
            df = with_class_rank(df, key, [*within, label], seed * 1000003 + order, "_rank")
            df = df.withColumns({name: ((F.col("_rank") - 1) % k).cast("int") for name, k in named.items()}).drop("_rank")
            continue
        ranked = class_rank(df, key, label, seed * 1000003 + order, list(within))
        df = null_safe_join(df, ranked.select(key, *[((F.col("rank") - 1) % k).cast("int").alias(name) for name, k in named.items()]), [key])
    return df


def fit_svm(df: DataFrame, columns: list[str], label: str, cost: float = 1.0, tol: float = 1e-3) -> Svm:
    """Linear SVM with balanced class weights n / (classes * n of the class);
    ``cost`` is the weight of the errors (C), summed over rows. It ends when the
    duality gap is at most ``tol`` of the objective."""
    rows = B.Rows.of(df.where(F.col(label).isNotNull()), label, columns, [])
    return _svms(rows, [_plain(columns)], [Want(0, (), columns, cost)], Settings(tol=tol), None)[0]


def calibrate(df: DataFrame, key: str, columns: list[str], label: str, cost: float, folds: int = 5, seed: int = 10, tol: float = 1e-3) -> Svm:
    """An SVM on all rows, with a sigmoid (Platt) fitted to margins of rows
    that the SVM behind them had not seen: ``folds`` stratified folds."""
    data = _tagged(df.where(F.col(label).isNotNull()).select(key, label, *[c for c in columns if c != key]), key, label, {"_p": folds}, seed)
    rows = B.Rows.of(data, label, columns, ["_p"])
    return _svms(rows, [_plain(columns)], [Want(0, (), columns, cost)], Settings(tol=tol, platt_folds=folds, seed=seed), 0)[0]


# ----------------------------------------------------------------- pipeline
@dataclass
class Fitted:
    """M6: the four fitted stages."""

    imputer: Imputer
    scaler: Scaler
    selector: Selector
    svm: Svm

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns with ``margin`` and ``prob``; every row stays."""
        z = self.scaler.transform(self.imputer.transform(df.select(*keep, *[c for c in self.imputer.columns if c not in keep])))
        return z.select(*keep, self.svm.margin().alias("margin"), self.svm.probability().alias("prob"))

    def save(self, spark: SparkSession, path: str) -> str:
        """The numbers as one JSON document in a folder."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").text(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        raw = json.loads(spark.read.text(path).first()[0])
        imputer = Imputer(**raw["imputer"] | {"rounds": [[Regression(**m) for m in models] for models in raw["imputer"]["rounds"]]})
        return Fitted(imputer, Scaler(**raw["scaler"]), Selector(**raw["selector"]), Svm(**raw["svm"]))


@dataclass(frozen=True)
class Settings:
    """Parameters that a search does not vary; ``tol`` is the SVM's relative duality gap."""

    selector: str | None = "elastic_net"
    rounds: int = 3
    n_nearest: int = 10
    k: int = 10
    threshold: float = 1e-5
    tol: float = 1e-3
    platt_folds: int = 5
    seed: int = 10


def prepare_all(rows: B.Rows, subsets: list[B.Subset], s: Settings, reg: float = 1e-3, low: float = -5000.0, high: float = 5000.0) -> list[tuple[Imputer, Scaler]]:
    """Imputer and scaler of every subset of the rows: two passes for all, or a
    pass a round for each subset where the moments do not suffice."""
    out, names = [], rows.features
    try:
        m = B.moments(rows, subsets)
    except B.Unbounded:
        m = None
    for f, subset in enumerate(subsets):
        try:
            if m is None:
                raise B.Unbounded
            means, rounds, center, scale = B.chained(m, f, names, s.rounds, s.n_nearest, reg, low, high)
            imputer = Imputer(list(names), means, [[Regression(*r) for r in models] for models in rounds], low, high)
            out.append((imputer, Scaler(list(names), center, scale)))
        except B.Unbounded:
            some = rows.df
            for tag, value, equal in subset:
                some = some.where((F.col(rows.tags[tag]) == value) == F.lit(equal))
            some = some.select(*[F.col(f"_f{i}").alias(f"f{i}") for i in range(len(names))])
            plain = [f"f{i}" for i in range(len(names))]
            imputer = fit_imputer_by_rows(some, plain, s.rounds, s.n_nearest, reg, low, high)
            scaler = fit_scaler(imputer.transform(some), plain)
            imputer.columns, scaler.columns = list(names), list(names)
            out.append((imputer, scaler))
    return out


def _as_arrays(imputer: Imputer, scaler: Scaler) -> B.Prepared:
    return B.Prepared(np.array(imputer.means), [[(m.target, m.predictors, np.array(m.coefs), m.intercept) for m in models] for models in imputer.rounds],
                      imputer.low, imputer.high, np.array(scaler.means), np.array(scaler.sds))


def fit_many(rows: B.Rows, wanted: list[tuple[B.Subset, dict]], s: Settings, platt: int | None) -> tuple[list[Fitted], list[B.Prepared], list[int]]:
    """All four stages for each (subset, cell): imputer and scaler once a
    subset, the selector once for each of its own parameters. Also the prepared
    forms of the subsets, and which one each pipeline has."""
    subsets = list(dict.fromkeys(subset for subset, _ in wanted))
    fitted = prepare_all(rows, subsets, s)
    prepared = [_as_arrays(*x) for x in fitted]
    at = {subset: i for i, subset in enumerate(subsets)}
    nets = list(dict.fromkeys((at[subset], subset, cell["alpha"], cell["l1_ratio"]) for subset, cell in wanted))
    chosen = dict(zip(nets, _selectors(rows, prepared, nets, s)))
    selectors = [chosen[(at[subset], subset, cell["alpha"], cell["l1_ratio"])] for subset, cell in wanted]
    svms = _svms(rows, prepared, [Want(at[subset], subset, sel.names, cell["cost"]) for (subset, cell), sel in zip(wanted, selectors)], s, platt)
    models = [Fitted(*fitted[at[subset]], sel, svm) for (subset, _), sel, svm in zip(wanted, selectors, svms)]
    return models, prepared, [at[subset] for subset, _ in wanted]


def laid(df: DataFrame, key: str, label: str, features: list[str], k: int = 3, s: Settings = Settings()) -> B.Rows | None:
    """The rows of ``df`` for a ``search`` in ``k`` folds and a ``fit``, ranked and stored once for both: their folds are
    of the same ranking. None where a key has rows of several classes: each call then lays its own."""
    some = df.where(F.col(label).isNotNull()).select(key, label, *features)
    if not one_class_a_key(some, key, [label]):
        return None
    return B.Rows.of(_tagged(some, key, label, {"_i0": (k, 0), "_p": (s.platt_folds, 0)}, s.seed, plain=True), label, features, ["_i0", "_p"])


def fit(df: DataFrame, key: str, label: str, features: list[str], cell: dict, s: Settings = Settings(), rows: B.Rows | None = None) -> Fitted:
    """All four stages on ``df``; ``cell`` holds cost, alpha and l1_ratio.
    Rows with a NULL label are left out of the fit. ``rows`` are those of ``df`` from ``laid``, if it was called."""
    if rows is None:
        data = _tagged(df.where(F.col(label).isNotNull()).select(key, label, *features), key, label, {"_p": s.platt_folds}, s.seed)
        rows = B.Rows.of(data, label, features, ["_p"])
    return fit_many(rows, [((), cell)], s, rows.tags.index("_p"))[0][0]


def cells(costs=(0.1, 1.0), alphas=(0.01,), l1_ratios=(0.5,)) -> list[dict]:
    """M7: the grid, one entry for each combination of stage parameters."""
    return [{"cost": c, "alpha": a, "l1_ratio": r} for a in alphas for r in l1_ratios for c in costs]


# M7: the grid of the study, 4 costs x 6 mixing ratios x 10 penalties.
STUDY_GRID = cells((0.001, 0.01, 0.1, 1.0), tuple(round(0.1 * i, 1) for i in range(1, 11)), (0.1, 0.5, 0.7, 0.9, 0.95, 0.99))


def _search(rows: B.Rows, outers: list[B.Subset], grid: list[dict], inner: list[int], k: int, metric: str, probas: bool, platt: int | None,
            s: Settings) -> list[list[tuple]]:
    """For each outer subset the grid's rows (alpha, l1_ratio, cost, score, sd, n) over all inner folds; ``inner`` are their tags."""
    if metric not in METRICS:
        raise ValueError(metric)
    probas = probas or metric == "brier"
    folds = [(o, tag, f) for o in range(len(outers)) for tag in inner for f in range(k)]
    wanted = [((*outers[o], (tag, f, False)), cell) for o, tag, f in folds for cell in grid]
    models, prepared, which = fit_many(rows, wanted, s, platt if probas else None)
    place = {c: i for i, c in enumerate(rows.features)}
    scores = []
    for i, (m, (o, tag, f)) in enumerate(zip(models, (x for x in folds for _ in grid))):
        scores.append(B.Scored(which[i], (*outers[o], (tag, f, True)), np.array([place[c] for c in m.svm.columns]), np.array([*m.svm.weights, m.svm.intercept]), (m.svm.a, m.svm.b) if probas else None))
    table = classification_metrics(cut_lineage(B.scored(rows, prepared, scores)), "_y", "score", ["part"], threshold=0.5 if probas else 0.0)
    found = {r["part"]: r[metric] for r in table.select("part", metric).collect()}
    out = []
    for o in range(len(outers)):
        of_cell = []
        for c, cell in enumerate(grid):
            got = [x for i, (at, _, _) in enumerate(folds) if at == o and (x := found.get(i * len(grid) + c)) is not None]
            of_cell.append((cell["alpha"], cell["l1_ratio"], cell["cost"], float(np.mean(got)) if got else None, float(np.std(got)) if got else None, len(got)))
        out.append(of_cell)
    return out


def _best(table: list[tuple], metric: str) -> int:
    sign = -1 if metric == "brier" else 1
    return max(range(len(table)), key=lambda i: (table[i][3] is not None, sign * (table[i][3] or 0.0), -i))


def search(df: DataFrame, key: str, label: str, features: list[str], grid: list[dict], k: int = 3, repeats: int = 1,
           metric: str = "auc", probas: bool = False, s: Settings = Settings(), rows: B.Rows | None = None) -> tuple[dict, DataFrame]:
    """M7: repeated stratified inner folds over the rows of ``df``.

    Returns the best cell (greatest mean score, least for the Brier score;
    ties: first) and the table (alpha, l1_ratio, cost, score, sd, n). All cells
    of all folds are fitted in common passes and scored by one query. Decisions
    are taken at margin 0, or with ``probas`` at calibrated probability 1/2,
    which the Brier score needs. ``rows`` are those of ``df`` from ``laid``
    with the same ``k``, if it was called; they serve one repeat without probabilities.
    """
    sigmoid = probas or metric == "brier"
    if rows is None or sigmoid or repeats > 1:
        tags, some = {f"_i{r}": k for r in range(repeats)}, df.where(F.col(label).isNotNull()).select(key, label, *features)
        plain = one_class_a_key(some, key, [label])
        if sigmoid or not plain:  # other folds are not read; rows of a key with several classes meet their ranks
            tags["_p"] = s.platt_folds
        rows = B.Rows.of(_tagged(some, key, label, tags, s.seed, plain=plain), label, features, [*tags])
    table = _search(rows, [()], grid, list(range(repeats)), k, metric, probas, repeats, s)[0]
    return grid[_best(table, metric)], df.sparkSession.createDataFrame(table, "alpha double, l1_ratio double, cost double, score double, sd double, n int")


@dataclass
class Nested:
    """What a nested cross-validation found."""

    oof: DataFrame      # (key, fold, label, prob), every key once
    params: DataFrame   # (fold, alpha, l1_ratio, cost, inner_score)
    models: list[Fitted]
    label: str
    trained: Callable[[], DataFrame]   # (fold, label, prob) of the training rows

    @cached_property
    def scores(self) -> DataFrame:
        """(fold, metric, score, split); the training rows are scored when it is asked for."""
        return metrics_long(classification_metrics(self.oof, self.label, "prob", ["fold"]), ["fold"], "test").unionByName(
            metrics_long(classification_metrics(self.trained(), self.label, "prob", ["fold"]), ["fold"], "train"))


def nested(df: DataFrame, key: str, label: str, features: list[str], grid: list[dict] | None = None, outer_k: int = 10, inner_k: int = 3,
           inner_repeats: int = 1, metric: str = "auc", probas: bool = False, s: Settings = Settings()) -> Nested:
    """M8: in each outer stratified fold the grid is searched on the training
    rows (a single cell needs no search), the best cell refitted on them, and all metrics are taken of the
    training and the held-out rows.

    Inner folds are laid within each outer fold, so they are even folds of
    every training set, and the searches of all outer folds run in the same passes.
    Rows are scored by the models of their own fold, and joined with nothing, unless keys repeat.
    """
    grid, repeats = grid or cells(), range(inner_repeats)
    data = df.where(F.col(label).isNotNull()).select(key, label, *features)
    # Rows of one key and class get the same folds, so what holds of the classes holds within the folds.
    plain, unique = key_kinds(data, key, [label])
    data = cut_lineage(_tagged(data, key, label, {"_outer": outer_k}, s.seed, plain=plain))
    inner_tags = {f"_i{r}": (inner_k, r) for r in repeats} if len(grid) > 1 or not plain else {}
    data = _tagged(data, key, label, inner_tags | {"_p": (s.platt_folds, inner_repeats)}, s.seed + 1, ["_outer"], plain=plain)
    rows = B.Rows.of(data, label, features, ["_outer", *inner_tags, "_p"], keep=[key])
    outers, platt = [((0, f, False),) for f in range(outer_k)], 1 + len(inner_tags)
    best, inner = [0] * outer_k, [None] * outer_k
    if len(grid) > 1:
        for f, table in enumerate(_search(rows, outers, grid, [1 + r for r in repeats], inner_k, metric, probas, platt, s)):
            best[f] = _best(table, metric)
            inner[f] = table[best[f]][3]
    models, prepared, which = fit_many(rows, [(outers[f], grid[best[f]]) for f in range(outer_k)], s, platt)
    place = {c: i for i, c in enumerate(features)}
    named = [F.col("part").alias("fold"), F.col("_y").alias(label), F.col("score").alias("prob")]

    def scores(subsets: list[B.Subset], keep: list[str]) -> DataFrame:
        ways = [B.Scored(which[f], subsets[f], np.array([place[c] for c in m.svm.columns]), np.array([*m.svm.weights, m.svm.intercept]), (m.svm.a, m.svm.b)) for f, m in enumerate(models)]
        return B.scored(rows, prepared, ways, keep)

    if unique:
        oof = cut_lineage(scores([((0, f, True),) for f in range(outer_k)], [key]).select(key, *named))
        trained = lambda: cut_lineage(scores(outers, []).select(*named))
    else:  # the rows of a key meet each other's folds
        both = cut_lineage(null_safe_join(scores([()] * outer_k, [key]), rows.df.select(key, "_outer"), [key]).select(key, *named, (F.col("_outer") == F.col("part")).alias("held")))
        oof = both.where("held").drop("held")
        trained = lambda: both.where("not held")
    params = [(f, grid[best[f]]["alpha"], grid[best[f]]["l1_ratio"], grid[best[f]]["cost"], inner[f]) for f in range(outer_k)]
    return Nested(oof, df.sparkSession.createDataFrame(params, "fold int, alpha double, l1_ratio double, cost double, inner_score double"), models, label, trained)


def selected(spark: SparkSession, model: Fitted) -> DataFrame:
    """The selector's columns with coefficient or F score, by value descending."""
    rows = [(c, model.selector.scores.get(c)) for c in model.selector.names]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(F.desc("value"), "feature")
