"""Separation of a logistic model (R2): terms without a finite estimate.

A direction of recession v raises (or keeps) the likelihood of every row for ever:
z.v >= 0 for all rows z = (2y - 1)(1, x), and > 0 for some. Such a direction exists
if and only if the point of the cone {v: z.v >= 0 for all rows} nearest to s, the sum
of the rows, is not zero (s.v is the sum of all z.v). That point is s plus a
non-negative combination of rows, found by non-negative least squares whose columns
are generated: each pass over the rows brings those that the present point violates
most, and the driver holds these few only. Rows that a direction separates are then
left out and the rest is searched again, until nothing is found.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors need not have this module: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A unit row violates a direction if their product is below -TOL of its length.
TOL = 1e-8
# The nearest point counts as zero below this share of the length of s.
ZERO = 1e-6
# Violated rows a task reports, and rows taken over in one pass.
A_TASK, A_PASS = 8, 64


def independent_columns(r: np.ndarray, share: float) -> tuple[list[int], np.ndarray]:
    """Columns of a triangular factor that are not combinations of earlier ones
    (what is left of them is above ``share`` of their length), and a basis."""
    used, basis = [], np.zeros((len(r), 0))
    for j in range(r.shape[1]):
        left = r[:, j]
        for _ in range(2):
            left = left - basis @ (basis.T @ left)
        if np.linalg.norm(left) > share * np.linalg.norm(r[:, j]):
            used.append(j)
            basis = np.column_stack([basis, left / np.linalg.norm(left)])
    return used, basis


def nearest(s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point nearest to ``s`` with no negative product with any of ``rows``
    (active-set non-negative least squares), and the rows it rests on."""
    weight, active = np.zeros(len(rows)), []
    point = s
    while True:
        products = rows @ point
        products[active] = 0.0
        worst = int(np.argmin(products)) if len(rows) else 0
        length = np.linalg.norm(point)
        if not len(rows) or length < ZERO * np.linalg.norm(s) or products[worst] >= -TOL * 0.1 * length:
            return point, rows[active]
        active.append(worst)
        while True:
            trial = np.linalg.lstsq(rows[active].T, -s, rcond=None)[0]
            if (trial > 0).all():
                weight[:] = 0.0
                weight[active] = trial
                break
            now = weight[active]
            falling = trial <= 0
            step = np.min(now[falling] / np.maximum(now[falling] - trial[falling], 1e-300))
            weight[active] = now + step * (trial - now)
            kept = [i for i, w in zip(active, weight[active]) if w > 1e-14]
            if kept == active:
                kept = [i for i, t in zip(active, trial) if t > 0]
            for i in set(active) - set(kept):
                weight[i] = 0.0
            active = kept
            if not active:
                break
        before, point = point, s + rows[active].T @ weight[active] if active else s
        if np.linalg.norm(point) >= np.linalg.norm(before) * (1 - 1e-14):
            return point, rows[active]


def _rows(batch: pa.RecordBatch, change: np.ndarray) -> np.ndarray:
    """Unit rows (2y - 1)(1, x) in the coordinates of ``change``; the label comes last."""
    x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
    z = (x[:, :-1] @ change) * np.where(x[:, -1:] == 1, 1.0, -1.0)
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return z / np.where(length > 0, length, 1.0)


def _sum(data: DataFrame, change: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(change.shape[1])
        for batch in batches:
            total += _rows(batch, change).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["j", "v"])

    found = {r["j"]: r["v"] for r in data.mapInArrow(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
    return np.array([found.get(j, 0.0) for j in range(change.shape[1])])


def _violated(data: DataFrame, change: np.ndarray, point: np.ndarray) -> np.ndarray:
    limit = -TOL * np.linalg.norm(point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = np.zeros(0), np.zeros((0, len(point)))
        for batch in batches:
            z = _rows(batch, change)
            value = z @ point
            some = value < limit
            best, rows = np.concatenate([best, value[some]]), np.vstack([rows, z[some]])
            # Equal rows count once, so that one hot pattern leaves room for others.
            _, first = np.unique(np.round(rows, 12), axis=0, return_index=True)
            first = first[np.argsort(best[first], kind="stable")[:A_TASK]]
            best, rows = best[first], rows[first]
        yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(list(rows), pa.list_(pa.float64()))], ["v", "z"])

    found = data.mapInArrow(run, "v double, z array<double>").distinct().orderBy("v").limit(A_PASS).collect()
    return np.array([r["z"] for r in found]).reshape(-1, len(point))


def recession_direction(data: DataFrame, change: np.ndarray) -> np.ndarray | None:
    """A direction of recession in the coordinates of ``change``, or None.
    ``data`` holds the columns and, last, the label."""
    s = _sum(data, change)
    size = np.linalg.norm(s)
    if size == 0:
        return None
    point, held = s / size, np.zeros((0, len(s)))
    s = point
    while True:
        more = _violated(data, change, point)
        if not len(more):
            return point
        before = np.linalg.norm(point)
        point, held = nearest(s, np.vstack([held, more]))
        now = np.linalg.norm(point)
        if now < ZERO:
            return None
        if now >= before * (1 - 1e-13):
            return point  # what is still violated is rounding


def on_the_boundary(cols: list[str], direction: np.ndarray, scale: np.ndarray) -> Column:
    """Rows whose product with a direction (intercept first) is zero, up to rounding."""
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    terms = [(v, float(b), float(w)) for v, b, w in zip(values, direction, scale) if b != 0]
    dot = reduce(lambda a, b: a + b, [v * b for v, b, _ in terms])
    size = reduce(lambda a, b: a + b, [F.greatest(F.abs(v), F.lit(w)) * abs(b) for v, b, w in terms])
    return F.abs(dot) <= size * 1e-7


def separated_terms(data: DataFrame, cols: list[str], r: np.ndarray, factor) -> tuple[set[int], DataFrame]:
    """Of the independent columns ``cols`` (0 is the intercept) those without a
    finite estimate, and the rows that no direction separates. ``data`` holds the
    columns and, last, the label (0 or 1, no NULLs); ``r`` is the triangular factor
    of (1, cols), and ``factor(frame)`` gives it for other rows."""
    change = np.linalg.inv(r)
    scale = np.linalg.norm(r, axis=0)
    scale = scale / scale[0]  # root mean squares of the columns
    rest, found = data, False
    for _ in range(len(cols) + 1):
        v = recession_direction(rest, change)
        if v is None:
            break
        found = True
        rest = rest.where(on_the_boundary(cols, change @ v, scale))
    if not found:
        return set(), data
    left = factor(rest)
    if not np.abs(left).max(initial=0.0) > 0:
        return set(range(len(cols) + 1)), rest
    _, size, directions = np.linalg.svd(left / np.linalg.norm(r, axis=0), full_matrices=True)
    size = np.concatenate([size, np.zeros(len(directions) - len(size))])
    free = directions[size <= 1e-9 * size[0]]
    return {j for j in range(len(cols) + 1) if np.linalg.norm(free[:, j]) > 1e-7}, rest
