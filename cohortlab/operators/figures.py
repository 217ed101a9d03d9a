"""Tables behind the reference's figures.

Only the aggregations are built; drawing is left to the caller. Group
statistics (min, max, n, sd) are one grouped table, brought to the data by a checked
broadcast, so the data is not dealt out by a few group keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .design import factor_levels
from .ranks import with_part_stats


def errorbar_scores(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Mean and population sd (ddof 0) of the scores of each model."""
    return scores.groupBy(model).agg(F.count(score).alias("n"), F.avg(score).alias("mean"),
                                     F.stddev_pop(score).alias("sd"))


def _group_range(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"),
                                 F.max(value).alias("_hi"), F.stddev_samp(value).alias("_sd"))


def histogram_by_group(df: DataFrame, value: str, group: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over each group's own [min, max], as counts
    and density n / (N * width). The last bin is closed (max falls in it);
    NULL values of a group are skipped (D16)."""
    src = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    rng = _group_range(src, value, group)
    lo, hi = F.col("_lo"), F.col("_hi")
    # A single-valued group gets a unit-wide range around its value.
    lo_e = F.when(hi > lo, lo).otherwise(lo - 0.5)
    hi_e = F.when(hi > lo, hi).otherwise(hi + 0.5)
    j = with_part_stats(src, rng, [group], 128).select(group, F.col(value).cast("double").alias("v"),
                                    lo_e.alias("lo"), hi_e.alias("hi"), "_n")
    b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1)).cast("int")
    g = j.groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"),
                                             F.first("hi").alias("hi"), F.first("_n").alias("_tot"))
    width = (F.col("hi") - F.col("lo")) / bins
    return g.select(group, "bin",
                    (F.col("lo") + F.col("bin") * width).alias("left"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
                    "n", (F.col("n") / (F.col("_tot") * width)).alias("density"))


# Highest moment of a box. With boxes one bandwidth wide, |value - middle| <= h / 2, and the terms
# left out of the Hermite series add up to less than 1e-11 a row (the bound is in tests/test_figures.py).
MOMENTS = 16
# A box further than this many bandwidths from a point adds less than exp(-60) a row.
REACH = 11


def _powers(x: F.Column, top: int) -> list[F.Column]:
    """x^0 .. x^top, each from two lower ones, so the products are shared."""
    out = [F.lit(1.0), x]
    while len(out) <= top:
        n = len(out)
        out.append(out[n // 2] * out[n - n // 2])
    return out


def kde_by_group(df: DataFrame, value: str, group: str, grid: int = 64,
                 bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of each group on ``grid`` evenly spaced
    points over the group's [min, max]. Bandwidth default: Scott's rule
    n^(-1/5) * sd (sample sd of the group); a group of one row or one value has
    no bandwidth, and NULL densities.

    A fast Gauss transform: rows are summed up as 17 moments of boxes one bandwidth
    wide, and the points are worked out from the boxes within eleven bandwidths by
    the Hermite series of the kernel. A row costs the same for any grid, and
    what is dealt out is one row a box. The density differs from the plain sum by
    less than 1e-11 / (h sqrt(2 pi)).
    """
    src = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    rng = cut_lineage(_group_range(src, value, group).withColumn(
        "_h", F.lit(float(bandwidth)) if bandwidth else F.pow(F.col("_n"), -0.2) * F.col("_sd")))
    h = F.col("_h")
    j = with_part_stats(src, rng, [group], 128).select(group, F.col(value).cast("double").alias("v"), "_lo", "_hi", "_h")
    j = j.where(h > 0).withColumn("_box", F.floor((F.col("v") - F.col("_lo")) / h))
    # In units of h sqrt(2), from the middle of the box.
    t = (F.col("v") - F.col("_lo") - (F.col("_box") + 0.5) * h) / (h * math.sqrt(2.0))
    powers = _powers(t, MOMENTS)
    boxes = j.groupBy(group, "_box").agg(F.count(F.lit(1)).cast("double").alias("m0"),
                                       *[F.first(c).alias(c) for c in ("_lo", "_hi", "_h")], *[F.sum(powers[p]).alias(f"m{p}") for p in range(1, MOMENTS + 1)])
    moments = F.array(*[F.col(f"m{p}") / float(math.factorial(p)) for p in range(MOMENTS + 1)]).alias("_m")
    boxes = boxes.select(group, "_box", "_lo", "_hi", "_h", moments)
    step = (F.col("_hi") - F.col("_lo")) / max(grid - 1, 1)
    middle = (F.col("_box") + 0.5) * h
    near = F.when(step > 0, F.sequence(F.greatest(F.lit(0), F.ceil((middle - REACH * h) / step)).cast("int"),
                                       F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((middle + REACH * h) / step))).cast("int"))) \
        .otherwise(F.sequence(F.lit(0), F.lit(grid - 1)))
    terms = boxes.select(group, "_m", "_h", middle.alias("_c"), step.alias("_step"), F.explode(near).alias("point"))
    u = (F.col("point") * F.col("_step") - F.col("_c")) / (F.col("_h") * math.sqrt(2.0))
    # Hermite functions by their recurrence, times the moments.
    first = F.struct(F.lit(0.0).alias("before"), F.exp(-F.col("_u") * F.col("_u")).alias("now"), F.lit(0.0).alias("sum"), F.lit(0).alias("p"))
    series = F.aggregate("_m", first, lambda a, m: F.struct(
        a["now"].alias("before"), (2.0 * F.col("_u") * a["now"] - 2.0 * a["p"] * a["before"]).alias("now"),
        (a["sum"] + m * a["now"]).alias("sum"), (a["p"] + 1).alias("p")), lambda a: a["sum"])
    none = F.lit(None).cast("double")
    sums = terms.withColumn("_u", u).select(group, "point", none.alias("x"), none.alias("_norm"), series.alias("_k"))
    norm = F.when(h > 0, F.col("_n") * h * math.sqrt(2 * math.pi))
    points = rng.select(group, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"), "_lo", step.alias("_step"), norm.alias("_norm"))
    points = points.select(group, "point", (F.col("_lo") + F.col("_step") * F.col("point")).alias("x"), "_norm", F.lit(0.0).alias("_k"))
    out = points.unionByName(sums).groupBy(group, "point").agg(F.max("x").alias("x"), F.max("_norm").alias("_norm"), F.sum("_k").alias("_k"))
    return out.select(group, "point", "x", (F.greatest(F.col("_k"), F.lit(0.0)) / F.col("_norm")).alias("density"))


def ordered_counts(df: DataFrame, x: str, hue: str, order: list | None, hue_levels: list) -> DataFrame:
    """Counts of ``x`` by ``hue`` in a given category order, zero for
    absent pairs; ``position`` is the place in ``order``. Both level lists are
    bounded literals (categories), so the order table is broadcast. Without an
    order the categories are those of the column, in their own order."""
    if order is None:
        order = factor_levels(df, x)
    counts = df.where(F.col(x).isin(list(order)) & F.col(hue).isin(list(hue_levels))) \
        .groupBy(x).pivot(hue, list(hue_levels)).agg(F.count(F.lit(1)))
    spark = df.sparkSession
    odf = F.broadcast(spark.createDataFrame([(i, v) for i, v in enumerate(order)],
                                            f"position int, {x} {dict(df.dtypes)[x]}"))
    j = odf.join(counts, x, "left")
    cells = F.explode(F.array(*[
        F.struct(F.lit(h).alias(hue), F.coalesce(F.col(f"`{h}`"), F.lit(0)).cast("bigint").alias("n"))
        for h in hue_levels])).alias("_c")
    return j.select("position", x, cells).select("position", x, f"_c.{hue}", "_c.n")
