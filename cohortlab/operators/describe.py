"""Describe, group summaries, counts, correlations, standardisation
(A1-A5, A10-A15).

Statistics for many columns come from one ``groupBy`` for all columns and all
groups, one scan and one shuffle of partial aggregates, instead of one job per
column or per stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import column_quantiles


def long_values(df: DataFrame, cols: list[str], by: list[str] | None = None,
                name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to ``(by..., column, value DOUBLE)``; NaN becomes NULL."""
    by = by or []
    casted = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    return casted.unpivot(by, cols, name, value)


def describe(df: DataFrame, cols: list[str], by: list[str] | None = None,
             digits: int | None = 2, approx: bool = False) -> DataFrame:
    """A1/A2: count, mean, std (n-1), min, 25/50/75 %, max per column (and group).

    Quantiles are exact (linear interpolation) by default; ``approx=True``
    uses ``percentile_approx`` (bounded memory sketch) instead.
    """
    by = by or []
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    points, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    if approx:
        keys = [*by, "column"]
        # NULLs stay in, so an all-NULL column still gets a row (count 0, other
        # statistics NULL) as pandas reports it.
        out = long_values(df, cols, by).groupBy(*keys).agg(
            F.count("value").alias("n"), *[fn("value").alias(m) for m, fn in moments.items()], F.percentile_approx("value", points, 10000).alias("_q"))
        out = out.withColumns({nm: F.get("_q", F.lit(i)) for i, nm in enumerate(names)})
    else:
        out = column_quantiles(df, by, cols, points, names, moments)
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    rnd = (lambda c: F.bround(F.col(c), digits)) if digits is not None else F.col
    return out.select(*by, "column", F.col("n").cast("bigint").alias("count"), *[rnd(c).alias(c) for c in stats])


def stratum_mean_std(df: DataFrame, value: str, strata: list[str],
                     digits: int | None = 2) -> DataFrame:
    """A3: mean and sample std of one column for every stratum, one pass."""
    g = df.groupBy(*strata).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                F.stddev_samp(value).alias("std"))
    if digits is None:
        return g
    return g.select(*strata, "n", F.bround("mean", digits).alias("mean"),
                    F.bround("std", digits).alias("std"))


def count_by_strata(df: DataFrame, strata: list[str]) -> DataFrame:
    """A4: row counts by a few flags."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """A5: counts per value, descending, with the share of all counted rows.
    The total is the sum of the written counts, used as a literal."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    g = cut_lineage(src.groupBy(col).agg(F.count(F.lit(1)).alias("count")))
    total = g.agg(F.sum("count")).first()[0] or 0
    return g.withColumn("share", F.col("count") / F.lit(float(max(total, 1)))) \
        .orderBy(F.desc("count"), F.col(col))


def flag_counts_by_outcome(df: DataFrame, flags: list[str], outcome: str,
                           levels=(0, 1)) -> DataFrame:
    """A10: sums of 0/1 flags per outcome level, one row per flag
    (the transposed groupby-sum), via unpivot + pivot on known levels."""
    long = df.select(outcome, *[F.col(c).cast("long").alias(c) for c in flags]) \
        .unpivot([outcome], flags, "flag", "value")
    p = long.groupBy("flag").pivot(outcome, list(levels)).agg(F.sum("value"))
    return p.select("flag", *[F.coalesce(F.col(str(lv)), F.lit(0)).cast("bigint")
                              .alias(f"n_{outcome}_{lv}") for lv in levels])


def crosstab(df: DataFrame, a: str, b: str, max_levels: int = 10000, zero_cells: bool = True) -> DataFrame:
    """Two-way table in long form ``(a, b, n)``.

    With ``zero_cells=False`` it is a plain grouped count, for any number of
    levels. Zero cells come from a pivot on the levels of ``b`` (a bounded list,
    checked against ``max_levels``) followed by an unpivot, not from a cross
    join of level lists.
    """
    if not zero_cells:
        return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                .groupBy(a, b).agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    levels = [r[0] for r in df.select(b).where(F.col(b).isNotNull()).distinct()
              .limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"crosstab: {b} has more than {max_levels} levels")
    levels = sorted(levels)
    names = [f"_l{i}" for i in range(len(levels))]
    wide = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()) \
        .groupBy(a).pivot(b, levels).agg(F.count(F.lit(1)))
    wide = wide.select(a, *[F.coalesce(F.col(f"`{lv}`"), F.lit(0)).cast("bigint").alias(nm)
                            for lv, nm in zip(levels, names)])
    stack = F.explode(F.array(*[F.struct(F.lit(lv).alias(b), F.col(nm).alias("n"))
                                for lv, nm in zip(levels, names)])).alias("_cell")
    return wide.select(a, stack).select(a, f"_cell.{b}", "_cell.n")


def target_correlations(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Pearson r of each column with a target over pairwise-complete
    rows, self excluded, sorted descending. Only k coefficients, not k^2."""
    cols = [c for c in cols if c != target]
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c)
                   for c in cols])
    return row.unpivot([], cols, "column", "r").orderBy(F.desc("r"), "column")


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """One-row aggregate of mean and sample std per column (to the driver)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """(x - mean) / std with std n-1, NULLs skipped; std 0 -> NULL.

    The statistics are one aggregated row; they enter the projection as
    literals, so the data is scanned once for them and once to transform.
    """
    stats = stats or column_stats(df, cols)

    def z(c: str) -> Column:
        m, s = stats[c]
        if m is None or s is None or s == 0:
            return F.lit(None).cast("double").alias(c)
        return ((F.col(c) - F.lit(m)) / F.lit(s)).alias(c)

    return df.select(*[z(c) if c in cols else F.col(c) for c in df.columns])
