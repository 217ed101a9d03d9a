"""Small generators for oracle SQL text (DuckDB dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column of a query result (both engines do)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def r(expr: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def describe_sql(src: str, cols: list[str], by: list[str] | None = None, digits: int = 2) -> str:
    by = by or []
    gb = f" GROUP BY {', '.join(by)}" if by else ""
    sel_by = "".join(f"{b}, " for b in by)
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {sel_by}'{c}' AS \"column\", count({x}) AS count, "
            f"round_even(avg({x}), {digits}) AS mean, round_even(stddev_samp({x}), {digits}) AS std, "
            f"round_even(min({x}), {digits}) AS min, "
            f"round_even(quantile_cont({x}, 0.25), {digits}) AS p25, "
            f"round_even(quantile_cont({x}, 0.5), {digits}) AS p50, "
            f"round_even(quantile_cont({x}, 0.75), {digits}) AS p75, "
            f"round_even(max({x}), {digits}) AS max FROM {src} WHERE {c} IS NOT NULL{gb}")
    return union(parts)


def midrank_sql(src: str, value: str, part: list[str], extra: list[str] | None = None) -> str:
    """Rows of ``src`` with ``_mid`` (mid-rank of value within part), ``_tie``
    (rows sharing the value in the part) and ``_total`` (rows in the part)."""
    extra = extra or []
    cols = ", ".join([*part, *extra, value])
    pp = f"PARTITION BY {', '.join(part)} " if part else ""
    tie = f"PARTITION BY {', '.join([*part, value])}"
    return (f"(SELECT {cols}, rank() OVER ({pp}ORDER BY {value}) "
            f"+ (count(*) OVER ({tie}) - 1) / 2.0 AS _mid, "
            f"count(*) OVER ({pp.strip()}) AS _total, count(*) OVER ({tie}) AS _tie "
            f"FROM {src} WHERE {value} IS NOT NULL)")
