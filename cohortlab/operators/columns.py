"""Projections on the schema.

Every operator here is a single ``select``/``drop``: Catalyst prunes the
parquet read schema to what survives, so dropping columns early costs
nothing and reading fewer columns is free.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _check(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in schema: {missing}")


def select_list(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep a list of columns; unknown names are an error."""
    _check(df, cols)
    return df.select(*cols)


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` by position, inclusive at both ends."""
    _check(df, [first, last])
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if j < i:
        raise ValueError(f"{last!r} comes before {first!r}")
    return cols[i:j + 1]


def select_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """``df.loc[:, first:last]``."""
    return df.select(*column_range(df, first, last))


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by dict; names not present are ignored (as a dict rename)."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Remove a leading prefix from every column name; a clash is an error."""
    pat = re.compile("^" + re.escape(prefix))
    new = [pat.sub("", c) for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"prefix removal makes duplicate names: {dup}")
    return df.toDF(*new)


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: drop by list (unknown names are an error)."""
    _check(df, cols)
    return df.drop(*cols)


def drop_strings(df: DataFrame) -> DataFrame:
    """Drop every string-typed column."""
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    return df.select(*keep)


def flag_index(df: DataFrame, flags: list[str], name: str = "flag_index") -> DataFrame:
    """Element-wise sum of 0/1 flags; a NULL flag makes the sum NULL."""
    _check(df, flags)
    return df.withColumn(name, reduce(add, [F.col(c).cast("int") for c in flags]))


def cast_all(df: DataFrame, dtype: str, cols: list[str] | None = None,
             strict: bool = False) -> DataFrame:
    """P10: whole-frame cast. ``strict=False`` uses ``try_cast``: a value
    that does not parse becomes NULL instead of failing the job (ANSI mode)."""
    cols = df.columns if cols is None else cols
    _check(df, cols)

    def conv(c: str) -> Column:
        return (F.col(c).cast(dtype) if strict else F.col(c).try_cast(dtype)).alias(c)

    return df.select(*[conv(c) if c in cols else F.col(c) for c in df.columns])


def modality_split(df: DataFrame, groups: dict[str, list[str]], outcome: str,
                   key: str | None = None) -> dict[str, DataFrame]:
    """One frame per modality (its columns + key + outcome) plus
    ``rest``: every column that is in no modality."""
    keep = ([key] if key else []) + [outcome]
    out = {}
    used = set()
    for name, cols in groups.items():
        _check(df, cols)
        used.update(cols)
        out[name] = df.select(*keep, *cols)
    out["rest"] = df.select(*[c for c in df.columns if c not in used])
    return out


def shift_key(df: DataFrame, key: str, offset: int) -> DataFrame:
    """Affine key shift."""
    return df.withColumn(key, F.col(key) + F.lit(offset))
