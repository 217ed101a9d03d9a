"""Row filters.

Filters are plain ``where`` clauses, so Catalyst pushes them through joins
and into the parquet scan (``PushedFilters`` in the plan).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import present

def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """F1."""
    return df.where(F.col(col) == F.lit(value))


def filter_and(df: DataFrame, *conds: Column) -> DataFrame:
    """conjunction of predicates."""
    return df.where(reduce(and_, conds))


def filter_threshold(df: DataFrame, col: str, k, op: str = ">=") -> DataFrame:
    """F3."""
    c = F.col(col)
    cond = {">=": c >= k, ">": c > k, "<=": c <= k, "<": c < k}[op]
    return df.where(cond)


def filter_notnull(df: DataFrame, col: str) -> DataFrame:
    """NaN counts as missing in a floating column, as in F5."""
    return df.where(present(df, col))


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """drop rows with any NULL (over ``cols`` or all columns)."""
    return df.na.drop("any", subset=cols)


def exclude_keys(df: DataFrame, key: str, keys: list | DataFrame) -> DataFrame:
    """drop rows whose key is in a list or in the key column of a frame.

    Rows with a NULL key stay, and a NULL among the keys excludes nothing,
    for either kind and any number of keys. A list is a predicate (pushed to
    the scan); a frame is a left-anti join, whose strategy Spark picks.
    """
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_anti")
    given = [k for k in keys if k is not None]
    return df.where(F.col(key).isNull() | ~F.col(key).isin(given)) if given else df


def first_n(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """first ``n`` rows in an explicit key order (top-k, not a scan prefix)."""
    return df.orderBy(*order_by).limit(n)


def mask_semi_join(df: DataFrame, mask_df: DataFrame, key: str,
                   mask: Column, extra: Column | None = None) -> DataFrame:
    """F8: keep rows whose key satisfies ``mask`` in another frame (a key
    missing there counts as False), then an optional local predicate."""
    keys = mask_df.where(mask).select(key)
    out = df.join(keys, key, "left_semi")
    return out.where(extra) if extra is not None else out


def profile_filter(profile: DataFrame, col: str, k) -> DataFrame:
    """rows of a long profile table with ``col >= k``."""
    return profile.where(F.col(col) >= k)


def drop_zero(df: DataFrame, col: str = "coef") -> DataFrame:
    """drop zero coefficients."""
    return df.where(F.col(col) != 0)
