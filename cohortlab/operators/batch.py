"""Many models in the same passes over a table.

A cross-validated search fits the same kinds of models on many subsets of one
table's rows. Here a row is read once a pass and adds to the sums of every
model whose subset holds it; the models' small systems are solved on the
driver. So the number of Spark jobs depends on the iterations of the slowest
model, not on folds or grid cells.

A table (``Rows``) has a 0/1 label, feature columns and small whole-number tags,
such as fold numbers; a subset is a conjunction of conditions on tags. Passes
read blocks, a few thousand rows as one packed row, so that a pass does not
turn every cell into Arrow again. Tasks send one vector of sums each, added up
in a tree of fan-in ``FAN_IN`` where they are many or long.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

# Executors need not have this module: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a table that one task reads, block by block (the start of a task would outweigh the sums of fewer),
# and that are worth a task; sums that one task adds up.
ROWS_PER_TASK, ROWS_A_TASK = 500_000, 1000
FAN_IN = 64
# Fits of a table of more than four times START_ROWS rows look for their starting point on every PICKED-th row.
START_ROWS, PICKED = 250_000, 8
# Rows of each label among the picked ones from which a logistic fit may start.
ENOUGH = 100
# Rows of a block of picked rows.
BLOCK_ROWS = 10_000
# Numbers of all tasks together that come to the driver without a tree.
GATHERED = 1_000_000
# Numbers that the models of one batch may send in a pass.
BATCH_NUMBERS = 4_000_000
# Missingness patterns, and numbers of their moments, that are gathered; beyond them rows are read in each round.
MAX_PATTERNS, MAX_MOMENTS = 4096, 30_000_000

Subset = tuple[tuple[int, int, bool], ...]
"""Conditions (tag, value, equal) that all hold."""


@dataclass
class Rows:
    """A stored table with columns ``_y``, the tags and the features, the same rows in blocks, and the number of its parts.

    ``some`` are evenly picked rows of a large table, from which fits take their first point."""

    df: DataFrame
    features: list[str]
    tags: list[str]
    parts: int
    blocks: DataFrame
    some: Rows | None = None
    patterns: list[Row] | None = None   # what ``moments`` found of the missingness patterns

    @staticmethod
    def of(df: DataFrame, label: str, features: list[str], tags: list[str], keep: list[str] = ()) -> Rows:
        """Written once, in as many parts as its rows need. Rows with a NULL label must be gone."""
        cells = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_f{i}") for i, c in enumerate(features)]
        table = cut_lineage(df.select(*keep, F.col(label).cast("int").alias("_y"), *[F.col(t).cast("int") for t in tags], *cells))
        n, cores = table.count(), df.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-n // ROWS_PER_TASK), min(cores, n // ROWS_A_TASK))
        if parts > cores:  # as many for each core
            parts = -(-parts // cores) * cores
        if table.rdd.getNumPartitions() < min(parts, cores):
            table = cut_lineage(table.repartition(parts))
        packed = table.select("_y", *tags, *[f"_f{i}" for i in range(len(features))])
        packed = packed.repartition(parts) if table.rdd.getNumPartitions() < parts else packed.coalesce(parts)
        rows = Rows(table, list(features), list(tags), parts, _blocks(packed, len(tags)))
        rows.some = rows.fewer(n)
        return rows

    def fewer(self, n: int) -> Rows | None:
        """Every ``PICKED``-th of ``n`` rows, and so on, as long as they are many."""
        if n < 4 * START_ROWS:
            return None
        out = Rows(self.df, self.features, self.tags, self.parts, _picked(self.blocks, len(self.tags), PICKED))
        out.some = out.fewer(n // PICKED)
        return out


def _blocks(table: DataFrame, tags: int) -> DataFrame:
    """The rows (label, tags, features) packed and stored, one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, t, x = _arrays(batch, tags)
                yield _pack(y, t, x)

    return _stored(table, run)


def _pack(y: np.ndarray, t: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A block. Labels are told apart by being 1 or not, so one byte holds them."""
    packed = [(y == 1).astype(np.int8).tobytes(), t.astype(np.int32).tobytes("F"), np.ascontiguousarray(x).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]], ["n", "y", "tags", "x"])


def _stored(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    path = scratch_path(df.sparkSession, "blocks")
    df.mapInArrow(run, "n int, y binary, tags binary, x binary").write.option("compression", "none").parquet(path)
    return df.sparkSession.read.parquet(path)


def _picked(blocks: DataFrame, tags: int, step: int) -> DataFrame:
    """Every ``step``-th row of the blocks, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, skip = [], 0
        for batch in batches:
            for y, t, x in _unpacked(batch, tags):
                found.append((y[skip::step], t[skip::step], x[skip::step].copy()))
                skip = (skip - len(y)) % step
        if found:
            y, t, x = (np.concatenate(part) for part in zip(*found))
            for at in range(0, len(y), BLOCK_ROWS):
                yield _pack(*(a[at:at + BLOCK_ROWS] for a in (y, t, x)))

    return _stored(blocks, run)


def _unpacked(batch: pa.RecordBatch, tags: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, tags and features of each block of a batch."""
    for i in range(batch.num_rows):
        n = batch.column(0)[i].as_py()
        y, t = (batch.column(k)[i].as_buffer() for k in (1, 2))
        x = np.frombuffer(batch.column(3)[i].as_buffer()).reshape(n, -1) if batch.num_columns > 3 else np.zeros((n, 0))
        yield np.frombuffer(y, np.int8), np.frombuffer(t, np.int32).reshape((n, tags), order="F"), x


def _arrays(batch: pa.RecordBatch, tags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, tags and features (missing: NaN) of a batch."""
    col = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
    t = np.stack([col(i + 1) for i in range(tags)], axis=1).astype(np.int64) if tags else np.zeros((batch.num_rows, 0), np.int64)
    return col(0).astype(np.int64), t, np.stack([col(i).astype(float) for i in range(1 + tags, batch.num_columns)], axis=1)


def members(tags: np.ndarray, subset: Subset) -> np.ndarray:
    out = np.ones(len(tags), bool)
    for tag, value, equal in subset:
        out &= (tags[:, tag] == value) == equal
    return out


def total(rows: Rows, size: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], features: bool = True) -> np.ndarray:
    """The sum of ``work(y, tags, x)``, a vector of ``size`` numbers, over all batches of the table: one pass.

    Without ``features`` only labels and tags are read, and x has no columns."""
    tags = len(rows.tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        out, part = np.zeros(size), TaskContext.get().partitionId()
        for batch in batches:
            for block in _unpacked(batch, tags):
                out += work(*block)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        parts, sums = table.column("part").to_pylist(), table.column("sums").to_pylist()
        return pa.table({"part": [min(parts)], "sums": pa.array([sum(np.frombuffer(s) for s in sums).tobytes()], pa.binary())})

    blocks = rows.blocks if features else rows.blocks.select("n", "y", "tags")
    found, parts = blocks.mapInArrow(run, "part long, sums binary"), rows.parts
    while parts > 8 and parts * size > GATHERED:
        parts = -(-parts // FAN_IN)
        found = found.groupBy((F.col("part") % parts).alias("_g")).applyInArrow(add, "part long, sums binary")
    return sum((np.frombuffer(bytes(r["sums"])) for r in sorted(found.collect())), np.zeros(size))


# ------------------------------------------------------- imputer and scaler
class Unbounded(Exception):
    """A predicted cell may pass the imputer's limits, or the patterns are too many: the sums do not suffice."""


@dataclass
class Moments:
    """Of each missingness pattern and subset: rows, sums and sums of products
    of the observed cells, in units of (x - center) / scale."""

    observed: np.ndarray      # patterns x columns
    low: np.ndarray           # least and greatest value of a pattern's cells, in units
    high: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    n: np.ndarray             # patterns x subsets
    sums: np.ndarray          # patterns x subsets x columns
    products: np.ndarray      # patterns x subsets x columns x columns


def moments(rows: Rows, subsets: list[Subset]) -> Moments:
    """One grouped pass for the patterns, the first time, and one pass for the sums."""
    p = len(rows.features)
    cells = [f"_f{i}" for i in range(p)]
    pattern = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cells])
    if rows.patterns is None:
        rows.patterns = (rows.df.groupBy(pattern.alias("_p")).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(k + c) for c in cells for k, f in (("lo", F.min), ("hi", F.max), ("s", F.sum), ("q", F.stddev_pop))])
                         .limit(MAX_PATTERNS + 1).collect())
    got = sorted(rows.patterns, key=lambda r: r["_p"])
    if len(got) > MAX_PATTERNS or len(got) * len(subsets) * p * p > MAX_MOMENTS:
        raise Unbounded
    observed = np.array([[c == "1" for c in r["_p"]] for r in got], dtype=bool).reshape(len(got), p)
    pick = lambda k, none: np.array([[none if r[k + c] is None else r[k + c] for c in cells] for r in got]).reshape(len(got), p)
    n = np.array([r["n"] for r in got])[:, None] * observed
    center = pick("s", 0.0).sum(axis=0) / np.maximum(n.sum(axis=0), 1)
    spread = np.sqrt((n * pick("q", 0.0) ** 2).sum(axis=0) / np.maximum(n.sum(axis=0), 1))
    scale = np.where(spread > 0, spread, 1.0)
    low, high = (pick("lo", 0.0) - center) / scale, (pick("hi", 0.0) - center) / scale
    shape = (len(got), len(subsets), 1 + p + p * p)
    place = {np.packbits(o).tobytes(): i for i, o in enumerate(observed)}

    def work(y: np.ndarray, tags: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        mask = np.stack([members(tags, s) for s in subsets], axis=1)
        seen = ~np.isnan(x)
        u = np.where(seen, (x - center) / scale, 0.0)
        code = np.packbits(seen, axis=1)
        if code.shape[1] == 1:  # up to 8 features: no sort
            kinds, where = np.flatnonzero(np.bincount(code[:, 0], minlength=256)).astype(np.uint8)[:, None], None
        else:
            kinds, where = np.unique(code, axis=0, return_inverse=True)
        for k, kind in enumerate(kinds):
            at = np.flatnonzero(code[:, 0] == kind[0] if where is None else where.ravel() == k)
            to = out[place[kind.tobytes()]]
            for f in range(len(subsets)):
                some = u[at[mask[at, f]]]
                to[f, 0] += len(some)
                to[f, 1:1 + p] += some.sum(axis=0)
                to[f, 1 + p:] += (some.T @ some).ravel()
        return out.ravel()

    sums = total(rows, int(np.prod(shape)), work).reshape(shape)
    return Moments(observed, low, high, center, scale, sums[:, :, 0], sums[:, :, 1:1 + p], sums[:, :, 1 + p:].reshape(len(got), len(subsets), p, p))


def chained(m: Moments, f: int, columns: list[str], rounds: int, n_nearest: int, reg: float, low: float, high: float):
    """The chained imputer of subset ``f`` and the scaler of the imputed rows, from moments alone.

    A filled cell is an affine function of its row's observed cells, so all
    rounds are matrix algebra on one affine map a pattern. Returns means,
    rounds of (target, predictors, coefficients, intercept), and the means and
    deviations of the filled columns; raises ``Unbounded`` where a prediction
    could reach ``low`` or ``high``.
    """
    p, n = len(columns), m.n[:, f]
    all_n, seen_n = n.sum(), (n[:, None] * m.observed).sum(axis=0)
    # A column without observed cells has the mean 0.
    mean = np.where(seen_n > 0, m.sums[:, f].sum(axis=0) / np.maximum(seen_n, 1), (0.0 - m.center) / m.scale)
    gaps = sorted((i for i in range(p) if 0 < seen_n[i] < all_n), key=lambda i: (all_n - seen_n[i], columns[i]))
    maps = [np.diag(o.astype(float)) for o in m.observed]
    adds = [np.where(o, 0.0, mean) for o in m.observed]

    def filled(some: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, means and covariances of the filled frame, over some patterns."""
        k, first, second = 0.0, np.zeros(p), np.zeros((p, p))
        for i in np.flatnonzero(some & (n > 0)):
            s = maps[i] @ m.sums[i, f]
            k += n[i]
            first += s + n[i] * adds[i]
            second += maps[i] @ m.products[i, f] @ maps[i].T + np.outer(s, adds[i]) + np.outer(adds[i], s) + n[i] * np.outer(adds[i], adds[i])
        first /= max(k, 1)
        return k, first, second / max(k, 1) - np.outer(first, first)

    def deviations(cov: np.ndarray) -> np.ndarray:
        var = np.diag(cov)
        return np.sqrt(np.where(var > 1e-13, var, 0.0))

    out, every = [], np.ones(len(n), bool)
    if gaps:
        _, _, cov = filled(every)
        sd = deviations(cov)
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.nan_to_num(cov / np.outer(sd, sd), nan=0.0, posinf=0.0, neginf=0.0)
        near = {t: sorted((j for j in range(p) if j != t), key=lambda j: (-abs(round(corr[j, t], 12)), j))[:n_nearest] for t in gaps}
    for _ in range(rounds if gaps else 0):
        models = []
        for t in gaps:
            _, mu, cov = filled(m.observed[:, t])
            sd, js = deviations(cov), near[t]
            by = np.where(sd > 0, sd, 1.0)
            g, y = cov[np.ix_(js, js)] / np.outer(by[js], by[js]), cov[js, t] / (by[js] * by[t])
            b = np.linalg.solve(g + reg * np.eye(len(js)), y) * sd[t] / by[js] if js else np.zeros(0)
            models.append((t, js, b, mu[t] - b @ mu[js]))
        old_maps, old_adds = [x.copy() for x in maps], [x.copy() for x in adds]
        for i in np.flatnonzero(n > 0):
            for t, js, b, start in models:
                if m.observed[i, t]:
                    continue
                maps[i][t], adds[i][t] = b @ old_maps[i][js], start + b @ old_adds[i][js]
                ends = np.stack([maps[i][t] * m.low[i], maps[i][t] * m.high[i]])
                least, most = (adds[i][t] + e.sum() for e in (ends.min(axis=0), ends.max(axis=0)))
                if m.center[t] + m.scale[t] * least < low or m.center[t] + m.scale[t] * most > high:
                    raise Unbounded
        out.append([(t, js, [float(x) for x in b * m.scale[t] / m.scale[js]], float(m.center[t] + m.scale[t] * start - (b * m.scale[t] / m.scale[js]) @ m.center[js])) for t, js, b, start in models])
    _, mu, cov = filled(every)
    sd = deviations(cov)
    return (m.center + m.scale * mean).tolist(), out, (m.center + m.scale * mu).tolist(), np.where(sd > 0, sd * m.scale, 1.0).tolist()


@dataclass
class Prepared:
    """A fitted imputer and scaler in array form."""

    means: np.ndarray
    rounds: list[list[tuple[int, list[int], np.ndarray, float]]]
    low: float
    high: float
    center: np.ndarray
    scale: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        gap = np.isnan(x)
        z = np.where(gap, self.means, x)
        at = np.flatnonzero(gap.any(axis=1)) if self.rounds else []
        if len(at):
            now, open_ = z[at], gap[at]
            for models in self.rounds:
                new = now.copy()
                for t, js, b, start in models:
                    new[:, t] = np.where(open_[:, t], np.clip(start + now[:, js] @ b, self.low, self.high), now[:, t])
                now = new
            z[at] = now
        return (z - self.center) / self.scale

    def columns(self, x: np.ndarray, cols: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """``apply`` of features x rows, for some columns; ``gaps`` are the rows with missing cells."""
        z = (x[cols] - self.center[cols, None]) / self.scale[cols, None]
        if len(gaps):
            z[:, gaps] = self.apply(x[:, gaps].T)[:, cols].T
        return z


# ------------------------------------------------------------------- models
@dataclass
class Problem:
    """A model with some columns on a subset, fitted by damped Newton steps.

    ``point`` holds the weights and last the intercept; ``at`` where the sums
    are asked for next.
    """

    prepared: int
    subset: Subset
    cols: np.ndarray
    point: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    done: bool = field(init=False, default=False)
    value: float = field(init=False, default=float("inf"))
    passes: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.at = self.point = np.zeros(len(self.cols) + 1)
        self.way, self.length, self.slope = np.zeros_like(self.point), 1.0, 0.0

    def size(self) -> int:
        raise NotImplementedError

    def sums(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = z[:, self.cols].T
        return self.by_class(z[:, y != 1], z[:, y == 1])

    def by_class(self, neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """``sums`` of the rows with label 0 and 1, each as the model's columns x rows."""
        raise NotImplementedError

    def judge(self, sums: np.ndarray) -> tuple[float, np.ndarray | None, float]:
        """Objective at ``at``; the next direction (None: ended) and the objective's predicted change along it."""
        raise NotImplementedError

    def update(self, sums: np.ndarray) -> None:
        self.passes += 1
        value, way, slope = self.judge(sums)
        if not np.isfinite(value):
            raise ValueError("a fit met values that are missing or not finite")
        if value > self.value + 1e-4 * self.length * self.slope + 1e-13 * (1 + abs(value)):
            self.length /= 2
            if self.length < 1e-9:
                self.stuck()
            else:
                self.at = self.point + self.length * self.way
            return
        self.point, self.value = self.at, value
        if way is None:
            self.done = True
            return
        self.way, self.slope, self.length = way, slope, 1.0
        self.at = self.point + way

    def stuck(self) -> None:
        """No step of any length lowers the objective beyond rounding: this is the optimum."""
        self.done = True


@dataclass
class Logistic(Problem):
    """Mean logistic loss + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2), intercept free; proximal Newton."""

    alpha: float = 0.0
    l1_ratio: float = 0.0
    targets: tuple[float, float] = (0.0, 1.0)

    def size(self) -> int:
        k = len(self.cols) + 1
        return 2 + k + k * k

    def by_class(self, neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
        n = neg.shape[1] + pos.shape[1]
        x = np.vstack([np.hstack([neg, pos]), np.ones((1, n))]).T
        m = x @ self.at
        t = np.repeat(self.targets, [neg.shape[1], pos.shape[1]])
        q = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
        loss = np.logaddexp(0, m) - t * m
        return np.concatenate([[n, loss.sum()], x.T @ (q - t), (x.T @ (x * (q * (1 - q))[:, None])).ravel()])

    def update(self, sums: np.ndarray) -> None:
        if self.value == float("inf") and self.at.any() and not self.judge(sums)[0] <= np.log(2):
            # A start from picked rows that is worse than none (all weights 0).
            self.passes += 1
            self.at = self.point = np.zeros_like(self.point)
            return
        super().update(sums)

    def judge(self, sums: np.ndarray):
        k, n = len(self.at), max(sums[0], 1.0)
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        w = self.at[:-1]
        value = sums[1] / n + l1 * np.abs(w).sum() + l2 / 2 * w @ w
        g, h = sums[2:2 + k] / n, sums[2 + k:].reshape(k, k) / n
        h = h + 1e-12 * np.eye(k)
        way = _penalised_step(self.at, g, h, l1, l2)
        slope = g @ way + l1 * (np.abs(w + way[:-1]).sum() - np.abs(w).sum()) + l2 * (w @ way[:-1])
        ended = np.abs(way).max() < 1e-8 * (1 + np.abs(self.at).max()) or -slope < 1e-14
        return value, None if ended else way, min(slope, 0.0)


def _penalised_step(x: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The least of g d + d h d / 2 + penalty(x + d), by coordinate descent; the last entry has no penalty."""
    k = len(x)
    if l1 == 0:
        ridge = np.diag([*[l2] * (k - 1), 0.0])
        return -np.linalg.solve(h + ridge, g + ridge @ x)
    d, hd = np.zeros(k), np.zeros(k)
    for _ in range(10_000):
        moved = 0.0
        for j in range(k):
            slope, curve, now = g[j] + hd[j] - h[j, j] * d[j], h[j, j], x[j]
            if j == k - 1:
                new = -slope / curve
            else:
                # The best weight u = now + d: soft threshold of curve * now - slope.
                pull = curve * now - slope
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (curve + l2) - now
            step = new - d[j]
            if step:
                hd += h[:, j] * step
                d[j] = new
                moved = max(moved, abs(step))
        if moved < 1e-12 * (1 + np.abs(x).max()):
            break
    return d


@dataclass
class Hinge(Problem):
    """M5: w^2 / 2 + sum of c_i * max(0, 1 - y_i * margin), c_i = cost * n / (2 * n of the class).

    Damped Newton steps on the hinge rounded over a width. The gap to the dual
    objective of the same point bounds what any other weights could gain; it
    has a part from the rounding and one from the steps not taken yet. Where
    the first outweighs the second the width shrinks. The fit ends when the gap
    is at most ``tol`` of the objective.
    """

    cost: float = 1.0
    counts: tuple[float, float] = (1.0, 1.0)
    tol: float = 1e-3
    gap: float = float("inf")
    primal: float = float("inf")
    width: float = 2.0
    damping: float = 1e-3

    def size(self) -> int:
        k = len(self.cols)
        return 5 + 2 * k + (k + 1) ** 2

    def by_class(self, neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
        k, n, w = len(self.cols), sum(self.counts), self.at[:-1]
        sums, dual, pull, curve = np.zeros(3), [], [], np.zeros((k + 1, k + 1))
        for x, side, count in ((pos, 1.0, self.counts[1]), (neg, -1.0, self.counts[0])):
            c = self.cost * n / (2 * max(count, 1))
            u = np.maximum((1 - side * self.at[-1]) - (side * w) @ x, 0)
            a = np.minimum(u * (1 / self.width), 1)
            all_u, within = u.sum(), a @ u
            sums += c * np.array([all_u, within - self.width / 2 * (a @ a), all_u - within])
            dual.append(c * a.sum())
            pull.append(c * (x @ a))
            inside = (a > 0) & (a < 1)
            some = np.count_nonzero(inside)
            # Products of the rows inside: all rows with the others at 0 where they are many, else gathered.
            held = x.take(np.flatnonzero(inside), axis=1) if 3 * some < len(a) else x * inside
            first = held.sum(axis=1)
            curve[:k, :k] += (held @ held.T) * (c / self.width)
            curve[:k, k] += first * (c / self.width)
            curve[k, :k] += first * (c / self.width)
            curve[k, k] += some * (c / self.width)
        return np.concatenate([sums, dual, *pull, curve.ravel()])

    def update(self, sums: np.ndarray) -> None:
        self.passes += 1
        k = len(self.cols)
        hinge, rounded, from_width, a1, a0 = sums[:5]
        x1, x0, h = sums[5:5 + k], sums[5 + k:5 + 2 * k], sums[5 + 2 * k:].reshape(k + 1, k + 1)
        w = self.at[:-1]
        value, primal = w @ w / 2 + rounded, w @ w / 2 + hinge
        if not np.isfinite(value):
            raise ValueError("a fit met values that are missing or not finite")
        # Weights of the dual: those of the heavier class shrunk, so that both classes weigh the same.
        least = min(a1, a0)
        v = x1 * (least / a1 if a1 else 0.0) - x0 * (least / a0 if a0 else 0.0)
        gap = primal - (2 * least - v @ v / 2)
        if gap <= self.tol * primal + 1e-9:
            self.point, self.gap, self.primal, self.done = self.at, gap, primal, True
        elif value > self.value + 1e-4 * self.slope + 1e-13 * abs(value):
            self.damping *= 8
            if self.damping > 1e9:
                self._narrow()
            else:
                self._go()
        else:
            self.point, self.value = self.at, value
            self.damping = max(self.damping / 8, 1e-12)
            self.grad, self.curve = np.append(w - (x1 - x0), a0 - a1), h + np.diag([*[1.0] * k, 0.0])
            if gap - from_width <= from_width:
                self._narrow()
            else:
                self._go()

    def _go(self) -> None:
        """A step from the point, shorter the greater the damping."""
        by = self.damping * (1 + sum(self.counts) * self.cost)
        way = -np.linalg.solve(self.curve + by * np.eye(len(self.at)), self.grad)
        self.at, self.slope = self.point + way, float(self.grad @ way)

    def _narrow(self) -> None:
        """The rounded problem is solved well enough: go on from its point with a smaller width."""
        if self.width < 1e-12:
            raise ArithmeticError("the duality gap does not close")
        self.width *= 0.3
        self.at, self.value, self.slope, self.damping = self.point, float("inf"), 0.0, 1e-3


def _begin(rows: Rows, prepared: list[Prepared], problems: list[Problem]) -> None:
    """Starting points and widths from the same problems on ``rows.some``, the
    errors weighing as much in all. Only the number of passes depends on it:
    an SVM ends by the duality gap over all its rows, a logistic fit by its step over all of them."""
    subsets = list(dict.fromkeys(p.subset for p in problems))
    counts = dict(zip(subsets, class_counts(rows.some, subsets)))
    pairs = []
    for p in problems:
        if isinstance(p, Logistic):
            if min(counts[p.subset]) >= ENOUGH:
                pairs.append((p, Logistic(p.prepared, p.subset, p.cols, p.alpha, p.l1_ratio, p.targets)))
        elif min(counts[p.subset]) > 0:
            share = sum(p.counts) / sum(counts[p.subset])
            pairs.append((p, Hinge(p.prepared, p.subset, p.cols, cost=p.cost * share, counts=counts[p.subset], tol=p.tol)))
    try:
        solve(rows.some, prepared, [small for _, small in pairs])
    except ArithmeticError:  # a gap that does not close on few rows says nothing of all
        return
    for p, small in pairs:
        p.at = p.point = small.point
        if isinstance(p, Hinge):
            p.width = small.width


def solve(rows: Rows, prepared: list[Prepared], problems: list[Problem]) -> None:
    """All problems fitted in common passes, as many at once as ``BATCH_NUMBERS`` allows."""
    if rows.some is not None and (left := [p for p in problems if not p.done]):
        _begin(rows, prepared, left)
    waiting = list(problems)
    while waiting:
        batch, numbers = [], 0
        while waiting and (not batch or numbers + waiting[0].size() <= BATCH_NUMBERS):
            numbers += waiting[0].size()
            batch.append(waiting.pop(0))
        while live := [p for p in batch if not p.done]:
            found = total(rows, sum(p.size() for p in live), _gather(prepared, live))
            at = 0
            for p in live:
                p.update(found[at:at + p.size()])
                at += p.size()


def _gather(prepared: list[Prepared], live: list[Problem]):
    used: dict[int, list[tuple[int, Problem]]] = {}
    for i, p in enumerate(live):
        used.setdefault(p.prepared, []).append((i, p))
    cols = {f: np.unique(np.concatenate([p.cols for _, p in some])).astype(int) for f, some in used.items()}
    own = {f: prepared[f] for f in used}

    def work(y: np.ndarray, tags: np.ndarray, x: np.ndarray) -> np.ndarray:
        out: list[np.ndarray | None] = [None] * len(live)
        pos, open_, x = y == 1, np.isnan(x).any(axis=1), np.ascontiguousarray(x.T)
        gaps = np.flatnonzero(open_)
        for f, some in used.items():
            held = {p.subset: members(tags, p.subset) for _, p in some}
            # Only rows that some model reads are prepared.
            at = np.flatnonzero(np.logical_or.reduce([*held.values()]))
            if 2 * len(at) < len(y):
                z, to, side_of = own[f].columns(x.take(at, axis=1), cols[f], np.flatnonzero(open_[at])), at, pos[at]
            else:
                z, to, side_of = own[f].columns(x, cols[f], gaps), slice(None), pos
            sides = {}
            for i, p in some:
                if p.subset not in sides:
                    mine = held[p.subset][to]
                    sides[p.subset] = [z.take(np.flatnonzero(mine & side), axis=1) for side in (~side_of, side_of)]
                place = np.searchsorted(cols[f], p.cols)
                out[i] = p.by_class(*[side if len(place) == len(side) else side[place] for side in sides[p.subset]])
        return np.concatenate(out)

    return work


def class_counts(rows: Rows, subsets: list[Subset]) -> list[tuple[float, float]]:
    """Rows with label 0 and 1 of each subset."""

    def work(y: np.ndarray, tags: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.array([(~(y == 1) & s).sum() if k == 0 else ((y == 1) & s).sum() for s in (members(tags, sub) for sub in subsets) for k in (0, 1)], dtype=float)

    found = total(rows, 2 * len(subsets), work, False)
    return [(float(found[2 * i]), float(found[2 * i + 1])) for i in range(len(subsets))]


def f_scores(rows: Rows, prepared: list[Prepared], subsets: list[tuple[int, Subset]]) -> list[np.ndarray]:
    """M4: the ANOVA F of every column between the two labels, of each (prepared, subset)."""
    p = len(rows.features)

    def work(y: np.ndarray, tags: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = []
        for f, subset in subsets:
            some = members(tags, subset)
            z, t = prepared[f].apply(x[some]), y[some] == 1
            for part in (z[~t], z[t]):
                out += [[len(part)], part.sum(axis=0), (part * part).sum(axis=0)]
        return np.concatenate(out)

    found = total(rows, len(subsets) * 2 * (1 + 2 * p), work).reshape(len(subsets), 2, 1 + 2 * p)
    out = []
    for one in found:
        n, s, q = one[:, :1], one[:, 1:1 + p], one[:, 1 + p:]
        with np.errstate(divide="ignore", invalid="ignore"):
            within = (q - s * s / n).sum(axis=0)
            between = (s * s / n).sum(axis=0) - s.sum(axis=0) ** 2 / n.sum()
            out.append(np.nan_to_num(between / (within / (n.sum() - 2)), nan=0.0, posinf=0.0, neginf=0.0))
    return out


@dataclass
class Scored:
    """A margin to take of the rows of a subset: weights on prepared columns, then a sigmoid if there is one."""

    prepared: int
    subset: Subset
    cols: np.ndarray
    point: np.ndarray
    sigmoid: tuple[float, float] | None = None


def _margins(own: Prepared, x: np.ndarray, some: list[tuple[int, Scored, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, places, margins) of each (number, model, rows of its subset) of one prepared form.

    Only rows and columns that a model reads are prepared."""
    if not some:
        return
    at = np.flatnonzero(np.logical_or.reduce([held for _, _, held in some]))
    cols = np.unique(np.concatenate([m.cols for _, m, _ in some])).astype(int)
    x = np.ascontiguousarray(x.T if len(at) == len(x) else x[at].T)
    z = own.columns(x, cols, np.flatnonzero(np.isnan(x).any(axis=0)))
    for i, m, held in some:
        mine = np.flatnonzero(held[at])
        place = np.searchsorted(cols, m.cols)
        margin = m.point[:-1] @ (z if len(place) == len(z) else z[place])
        yield i, at[mine], margin.take(mine) + m.point[-1]


def scored(rows: Rows, prepared: list[Prepared], models: list[Scored], keep: list[str] = ()) -> DataFrame:
    """(keep, _y, part, score): every model's score of every row of its subset, ``part`` being the model's place."""
    tags, first = len(rows.tags), len(keep)
    fields = [f for f in rows.df.schema.fields if f.name in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "_y int, part int, score double"])
    used = {m.prepared: prepared[m.prepared] for m in models}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, t, x = _arrays(batch.select(range(first, batch.num_columns)), tags)
            for f, own in used.items():
                for i, at, score in _margins(own, x, [(i, m, members(t, m.subset)) for i, m in enumerate(models) if m.prepared == f]):
                    m = models[i]
                    if m.sigmoid:
                        score = 1 / (1 + np.exp(-np.clip(m.sigmoid[0] * score + m.sigmoid[1], -700, 700)))
                    kept = batch.select(range(first)).take(pa.array(at)).columns if first else []
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(y[at], pa.int32()), pa.array(np.full(len(at), i), pa.int32()), pa.array(score)], [*[f.name for f in fields], "_y", "part", "score"])

    return rows.df.select(*[f.name for f in fields], "_y", *rows.tags, *[f"_f{i}" for i in range(len(rows.features))]).mapInArrow(run, schema)


def sigmoids(rows: Rows, prepared: list[Prepared], held: list[list[Scored]], tol_counts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Platt's sigmoid of each list of models, whose subsets are disjoint, over
    the margins of all of them; targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)
    keep it finite where margins separate the labels."""
    fits = []
    for (n0, n1) in tol_counts:
        fits.append(Logistic(0, (), np.array([0]), targets=(1 / (n0 + 2), (n1 + 1) / (n1 + 2))))
        if not n0 or not n1:
            target = fits[-1].targets[1 if n1 else 0]
            fits[-1].point, fits[-1].done = np.array([0.0, np.log(target / (1 - target))]), True
    _fit_sigmoids(rows, prepared, held, fits)
    return [(float(f.point[0]), float(f.point[1])) for f in fits]


def _fit_sigmoids(rows: Rows, prepared: list[Prepared], held: list[list[Scored]], fits: list[Logistic]) -> None:
    """Common passes for all sigmoids that are not done, those of a large table from a start on ``rows.some``."""
    if rows.some is not None and (left := [i for i, f in enumerate(fits) if not f.done]):
        subsets = list(dict.fromkeys(m.subset for i in left for m in held[i]))
        counts = dict(zip(subsets, class_counts(rows.some, subsets)))
        left = [i for i in left if min(sum(counts[m.subset][k] for m in held[i]) for k in (0, 1)) >= ENOUGH]
        small = [Logistic(0, (), np.array([0]), targets=fits[i].targets) for i in left]
        _fit_sigmoids(rows.some, prepared, [held[i] for i in left], small)
        for i, s in zip(left, small):
            fits[i].at = fits[i].point = s.point
    while live := [i for i, f in enumerate(fits) if not f.done]:
        mine = {f: [(i, m) for i in live for m in held[i] if m.prepared == f] for f in {m.prepared for i in live for m in held[i]}}
        used = {f: prepared[f] for f in mine}

        def work(y: np.ndarray, tags: np.ndarray, x: np.ndarray) -> np.ndarray:
            out = {i: np.zeros(fits[i].size()) for i in live}
            for f, own in used.items():
                for i, at, margin in _margins(own, x, [(i, m, members(tags, m.subset)) for i, m in mine[f]]):
                    out[i] += fits[i].sums(margin[:, None], y[at])
            return np.concatenate([out[i] for i in live])

        found, at = total(rows, sum(fits[i].size() for i in live), work), 0
        for i in live:
            fits[i].update(found[at:at + fits[i].size()])
            at += fits[i].size()
