"""Statistical tests as distributed aggregates.

Every test reduces the data to sufficient statistics with one grouped
aggregate (counts, sums, rank sums), then derives the statistic and its
tail probability as column expressions on the few result rows. Many
variables are tested in one query through the unpivoted frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..session import cut_lineage
from .describe import long_values
from .ranks import COLUMNS_AT_ONCE, column_quantiles, fdr_bh, rank_sums, with_part_stats
from .rows import complete_cases


def kruskal(df: DataFrame, value: str, group: str, part: list[str] | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction; one row per part."""
    part = part or []
    rs = rank_sums(df.where(F.col(group).isNotNull()), part, group, value)
    # Deviations of the mean ranks from their expectation, so no two numbers
    # of the size of N are subtracted.
    off = F.col("rank_sum") / F.col("n") - (F.col("total") + 1.0) / 2.0
    g = rs.groupBy(*part).agg(
        F.sum("n").cast("double").alias("N"),
        F.sum(F.col("n") * off * off).alias("S"),
        F.sum("tie_term").alias("T"),
        F.count(F.lit(1)).alias("k"))
    N = F.col("N")
    # try_divide: all values tied (or one row) leave H undefined -> NULL.
    h = F.try_divide(12.0 / (N * (N + 1.0)) * F.col("S"), 1.0 - F.try_divide(F.col("T"), N * N * N - N))
    out = g.select(*part, h.alias("H"), (F.col("k") - 1).cast("bigint").alias("df"),
                   F.col("N").cast("bigint").alias("n"))
    return out.withColumn("p", D.chi2_sf("H", "df"))


def mann_whitney(df: DataFrame, value: str, group: str, x_level, part: list[str] | None = None,
                 alternative: str | None = None, use_continuity: bool = True) -> DataFrame:
    """Mann-Whitney U with tie correction, normal approximation.

    ``alternative=None`` is the legacy convention of the reference: U is the
    smaller of the two U values and p the one-sided tail of |z|.
    'two-sided', 'less', 'greater' follow the current convention (U of x).
    Every part gives a row: one without exactly two groups (``n_groups``) has
    NULL statistics.
    """
    part = part or []
    rs = rank_sums(df.where(F.col(group).isNotNull()), part, group, value)
    isx = F.col(group) == F.lit(x_level)
    g = rs.groupBy(*part).agg(
        F.sum(F.when(isx, F.col("rank_sum"))).alias("Rx"),
        F.sum(F.when(isx, F.col("n"))).cast("double").alias("nx"),
        F.sum(F.when(~isx, F.col("n"))).cast("double").alias("ny"),
        F.sum("tie_term").alias("T"),
        F.count(F.lit(1)).alias("k"))
    nx, ny = F.col("nx"), F.col("ny")
    N = nx + ny
    ux = F.col("Rx") - nx * (nx + 1.0) / 2.0
    uy = nx * ny - ux
    sd = F.sqrt((1.0 - F.try_divide(F.col("T"), N * N * N - N)) * nx * ny * (N + 1.0) / 12.0)
    mu = nx * ny / 2.0
    cc = 0.5 if use_continuity else 0.0
    if alternative is None:
        z, u = F.try_divide(F.greatest(ux, uy) - mu - cc, sd), F.least(ux, uy)
        p = D.norm_sf("abs(z)")
    elif alternative == "two-sided":
        z, u = F.try_divide(F.greatest(ux, uy) - mu - cc, sd), ux
        p = F.least(F.lit(1.0), 2.0 * D.norm_sf("z"))
    elif alternative == "greater":
        z, u = F.try_divide(ux - mu - cc, sd), ux
        p = D.norm_sf("z")
    elif alternative == "less":
        z, u = F.try_divide(uy - mu - cc, sd), ux
        p = D.norm_sf("z")
    else:
        raise ValueError(alternative)
    two = F.col("k") == 2
    out = g.select(*part, F.when(two, u).alias("U"), F.when(two, z).alias("z"), nx.cast("bigint").alias("n_x"),
                   ny.cast("bigint").alias("n_y"), F.col("k").cast("bigint").alias("n_groups"))
    return out.select(*part, "U", "z", p.alias("p"), "n_x", "n_y", "n_groups")


def _two_group_moments(df: DataFrame, cols: list[str], group: str, a, b):
    long = long_values(df, cols, [group]).where(F.col("value").isNotNull())
    ga, gb = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    v = F.col("value")
    return long.groupBy("column").agg(
        F.count(F.when(ga, v)).cast("double").alias("na"),
        F.avg(F.when(ga, v)).alias("ma"),
        F.var_samp(F.when(ga, v)).alias("va"),
        F.count(F.when(gb, v)).cast("double").alias("nb"),
        F.avg(F.when(gb, v)).alias("mb"),
        F.var_samp(F.when(gb, v)).alias("vb"))


def ttest(df: DataFrame, cols: list[str], group: str, a=1, b=0, equal_var: bool = True) -> DataFrame:
    """T3 (pooled) / T4 (Welch): two-sample t-test per column, NULLs omitted."""
    m = _two_group_moments(df, cols, group, a, b)
    na, nb, va, vb = F.col("na"), F.col("nb"), F.col("va"), F.col("vb")
    diff = F.col("ma") - F.col("mb")
    if equal_var:
        dof = na + nb - 2.0
        sp2 = F.try_divide((na - 1.0) * va + (nb - 1.0) * vb, dof)
        se = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    else:
        qa, qb = F.try_divide(va, na), F.try_divide(vb, nb)
        se = F.sqrt(qa + qb)
        dof = F.try_divide((qa + qb) * (qa + qb),
                           F.try_divide(qa * qa, na - 1.0) + F.try_divide(qb * qb, nb - 1.0))
    t = F.try_divide(diff, se)
    out = m.select("column", t.alias("t"), dof.alias("df"))
    return out.withColumn("p", D.t_sf_two_sided("t", "df"))


def _oneway_from_groups(g: DataFrame, keys: list[str]) -> DataFrame:
    """One-way ANOVA F from per-group (n, mean, var) rows. The sum of squares
    between groups is taken of deviations from the grand mean, so a common
    offset of the data does not cancel digits."""
    w = Window.partitionBy(*keys)
    some = F.first("mean").over(w)  # any group's mean as origin keeps the sum small
    grand = F.col("_o") + F.sum(F.col("n") * (F.col("mean") - F.col("_o"))).over(w) / F.sum("n").over(w)
    dev = g.withColumn("_o", some).withColumn("_g", grand)
    agg = dev.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_g")) * (F.col("mean") - F.col("_g"))).alias("between"),
        F.sum((F.col("n") - 1.0) * F.coalesce(F.col("var"), F.lit(0.0))).alias("within"))
    N, k = F.col("N"), F.col("k").cast("double")
    f = F.try_divide(F.try_divide(F.col("between"), k - 1.0), F.try_divide(F.col("within"), N - k))
    out = agg.select(*keys, f.alias("F"), (k - 1.0).alias("df_between"), (N - k).alias("df_within"))
    return out.withColumn("p", D.f_sf("F", "df_between", "df_within"))


def anova_f(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """ANOVA F of each feature across label classes (f_classif)."""
    long = long_values(df, cols, [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    g = long.groupBy("column", label).agg(F.count("value").cast("double").alias("n"),
                                          F.avg("value").alias("mean"),
                                          F.var_samp("value").alias("var"))
    return _oneway_from_groups(g, ["column"])


def levene_median(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """T5: Brown-Forsythe / Levene with median centring, per column.

    Group medians are exact; the median table has one row a group and is
    brought to the data by a checked broadcast. The frame stays wide, and
    the deviations are summed up by group for a block of columns at a time.
    """
    src = df.where(F.col(group).isNotNull()).select(group, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)])
    groups = []
    for at in range(0, len(cols), COLUMNS_AT_ONCE):
        block = {f"_x{i}": c for i, c in list(enumerate(cols))[at:at + COLUMNS_AT_ONCE]}
        part = src.select(group, *block)
        med = cut_lineage(column_quantiles(part, [group], list(block), [0.5], ["median"])).groupBy(group).agg(
            *[F.max(F.when(F.col("column") == x, F.col("median"))).alias(f"_m{x}") for x in block])
        z = with_part_stats(part, med, [group], 16 * len(block) + 64).select(group, *[F.abs(F.col(x) - F.col(f"_m{x}")).alias(x) for x in block])
        sums = z.groupBy(group).agg(*[a for x in block for a in (F.count(x).cast("double").alias(f"_n{x}"), F.avg(x).alias(f"_a{x}"), F.var_samp(x).alias(f"_v{x}"))])
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{x}").alias("n"), F.col(f"_a{x}").alias("mean"), F.col(f"_v{x}").alias("var"))
                                    for x, c in block.items()])).alias("_s")
        groups.append(sums.select(group, cells).select("_s.column", group, "_s.n", "_s.mean", "_s.var").where(F.col("n") > 0))
    return _oneway_from_groups(reduce(DataFrame.unionByName, groups), ["column"])


def _level_counts(df: DataFrame, cols: list[str], outcome: str, level_type: str = "string") -> DataFrame:
    """``(column, level, outcome, o)``: one grouped count over the unpivoted
    frame; the contingency tables of all columns at once."""
    long = df.select(outcome, *[F.col(c).cast(level_type).alias(c) for c in cols]) \
        .unpivot([outcome], cols, "column", "level") \
        .where(F.col("level").isNotNull() & F.col(outcome).isNotNull())
    return long.groupBy("column", "level", outcome).agg(F.count(F.lit(1)).cast("double").alias("o"))


def _chi2_from_counts(cnt: DataFrame, outcome: str) -> DataFrame:
    rt = F.sum("o").over(Window.partitionBy("column", "level"))
    ct = F.sum("o").over(Window.partitionBy("column", outcome))
    nn = F.sum("o").over(Window.partitionBy("column"))
    cells = cnt.select("column", "level", outcome, "o", (rt * ct / nn).alias("e"), nn.alias("N"))
    # Cells without rows are not here; each would add its e, together N - sum(e).
    gap = F.col("o") - F.col("e")
    g = cells.groupBy("column").agg(
        (F.sum(gap * gap / F.col("e")) + (F.first("N") - F.sum("e"))).alias("chi2"),
        ((F.count_distinct("level") - 1) * (F.count_distinct(outcome) - 1)).cast("bigint").alias("dof"),
        F.first("N").cast("bigint").alias("n"))
    return g.withColumn("p", D.chi2_sf("chi2", "dof"))


def chi2_independence(df: DataFrame, cols: list[str], outcome: str) -> DataFrame:
    """Pearson chi-square (no Yates) of each column against an outcome.

    Cells with zero count (absent from the grouped counts) add their expected
    counts, which is what those of the other cells leave of N. dof = (r - 1)(c - 1) over observed
    levels. The count table has (columns x levels x outcomes) rows.
    """
    return _chi2_from_counts(_level_counts(df, cols, outcome), outcome)


def chi2_expected(df: DataFrame, col: str, outcome: str) -> DataFrame:
    """The table of ``col`` against ``outcome`` with observed and expected
    counts ``(level, outcome, observed, expected)``, cells without rows included.

    The totals of levels and outcomes are joined on a constant-free key: every
    level row carries the array of outcome totals, as long as there are outcomes.
    """
    cnt = _level_counts(df, [col], outcome)
    by_outcome = cnt.groupBy("column", outcome).agg(F.sum("o").alias("c")).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct(F.col(outcome).alias("value"), "c"))).alias("outcomes"), F.sum("c").alias("n"))
    by_level = cnt.groupBy("column", "level").agg(F.sum("o").alias("r"), F.map_from_entries(F.collect_list(F.struct(outcome, "o"))).alias("seen"))
    cells = by_level.join(by_outcome, "column").select("level", "r", "seen", "n", F.explode("outcomes").alias("x"))
    return cells.select("level", F.col("x.value").alias(outcome), F.coalesce(F.try_element_at("seen", F.col("x.value")), F.lit(0.0)).cast("bigint").alias("observed"),
                        (F.col("r") * F.col("x.c") / F.col("n")).alias("expected"))


def flag_summary_with_p(df: DataFrame, flags: list[str], outcome: str, digits: int = 3,
                        alpha: float = 0.05, levels=(0, 1)) -> DataFrame:
    """Per flag, sums per outcome level (A10), chi-square p
    rounded, and the BH-adjusted p over the family of flags (T7).

    Rows with a missing flag or outcome are dropped first. Both the sums and
    the test come from one count table ``(flag, level, outcome) -> n``
    (sum of a flag = sum of level x n), so the data is scanned once.
    """
    cc = complete_cases(df.select(outcome, *flags))
    cnt = _level_counts(cc, flags, outcome, "double")
    sums = cnt.groupBy("column").pivot(outcome, list(levels)) \
        .agg(F.sum(F.col("level") * F.col("o")))
    counts = sums.select(F.col("column").alias("flag"), *[
        F.coalesce(F.col(str(lv)), F.lit(0.0)).cast("bigint").alias(f"n_{outcome}_{lv}") for lv in levels])
    tests = _chi2_from_counts(cnt, outcome).withColumnRenamed("column", "flag")
    tests = fdr_bh(tests, "p", order_tie=["flag"], alpha=alpha, out="p_fdr")
    return counts.join(tests, "flag").select(
        *counts.columns, F.round("chi2", 4).alias("chi2"), "dof",
        F.bround("p", digits).alias("p"), F.bround("p_fdr", digits).alias("p_fdr"))
