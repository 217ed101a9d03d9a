"""Scalar and conditional column functions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_key(c, offset: int) -> Column:
    """Drop the first ``offset`` characters (0-based, like ``str[k:]``)
    and read the rest as a BIGINT; a malformed id becomes NULL."""
    return F.substring(_c(c), offset + 1, 1 << 30).try_cast("bigint")


def regex_clean(c) -> Column:
    """Collapse each run of non-word characters to one space.
    ``(?U)`` makes ``\\W`` Unicode-aware, as Python's is."""
    return F.regexp_replace(_c(c), r"(?U)\W+", " ")


def value_strip_prefix(c, prefix: str) -> Column:
    """Remove every occurrence of a literal in the values."""
    return F.replace(_c(c), F.lit(prefix), F.lit(""))


def to_null_if(c, codes: list) -> Column:
    """C4/C5 element: a listed code becomes NULL, anything else is kept."""
    col = _c(c)
    return F.when(col.isin(list(codes)), F.lit(None)).otherwise(col)


def sentinel_to_null(df: DataFrame, codes=(-99, -999)) -> DataFrame:
    """C4: frame-wide sentinel codes to NULL on numeric columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC):
            cols.append(to_null_if(f.name, list(codes)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def column_rules_to_null(df: DataFrame, rules: dict[str, list]) -> DataFrame:
    """Per-column code lists to NULL (rule table column -> codes)."""
    missing = [c for c in rules if c not in df.columns]
    if missing:
        raise KeyError(f"rule columns not in schema: {missing}")
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select(*[
        to_null_if(c, rules[c]).cast(dtypes[c]).alias(c) if c in rules else F.col(c)
        for c in df.columns
    ])


def recode_map(c, mapping: dict) -> Column:
    """Value recode; values not in the map are kept unchanged
    (C7 with string targets: unmatched values become their string form)."""
    col = _c(c)
    items = list(mapping.items())
    if not items:
        return col
    expr = F.when(col == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(col.cast("string") if any(isinstance(v, str) for v in mapping.values()) else col)


def outcome_flag(a, b, a_value=1, b_min=1) -> Column:
    """1 when ``a == a_value`` and ``b >= b_min``; NULL comparisons give 0."""
    return F.coalesce(((_c(a) == a_value) & (_c(b) >= b_min)).cast("int"), F.lit(0))


def any_flag(cols: list, mode: str = "ge1") -> Column:
    """1 when any flag is set, else 0 (NULL counts as not set).
    ``mode='eq1'`` tests ``== 1`` as the reference does; default ``>= 1``."""
    test = (lambda c: _c(c) == 1) if mode == "eq1" else (lambda c: _c(c) >= 1)
    return reduce(or_, [F.coalesce(test(c), F.lit(False)) for c in cols]).cast("int")


def threshold_flag(c, k=1) -> Column:
    """1 when ``c >= k`` else 0 (NULL gives 0)."""
    return F.when(_c(c) >= k, 1).otherwise(0)


def round_half_even(c, d: int) -> Column:
    """C11: numpy-style rounding (ties to even)."""
    return F.bround(_c(c), d)


def odds_ratio(c) -> Column:
    """C12."""
    return F.exp(_c(c))


def abs_score(c) -> Column:
    """C13."""
    return F.abs(_c(c))


def fill_missing(c, value) -> Column:
    """C14."""
    return F.coalesce(_c(c), F.lit(value))


def aic(llf, n_params) -> Column:
    """-2 llf + 2 k (k counts the intercept)."""
    return F.lit(-2.0) * _c(llf) + F.lit(2.0) * _c(n_params)
