"""Distributed ranks and exact quantiles (W1, W2) without a global sort.

A rank needs the number of rows below a value. A window ordered over the
whole column would put every row into one task, so instead:

1. ties are pre-aggregated to ``(part, [group], value) -> n`` (a hot value
   holding a third of all rows becomes one row);
2. values are cut into buckets at approximate quantiles of their own part
   (``percentile_approx``), found by binary search in the part's array of
   cuts (O(log buckets) comparisons inside code generation); equal values
   always share a bucket, so the result does not depend on where the cuts
   fall, only the balance does, and outliers or infinities move no cut of
   another part;
3. per-bucket totals, summed from the tie table (parts x buckets rows), give
   each bucket's offset by a running sum;
4. inside a bucket a windowed running sum gives the count at or below each
   value; windows are partitioned by ``(part, bucket)``, so many tasks share
   the work, and the offsets are joined on the same keys.

Exact quantiles need no ranks of all values: a sketch brackets each wanted
position, the values below the bracket are counted and only those inside it
are grouped and ordered.

A NULL part is a part like any other: all joins on parts are null-safe.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Size up to which a table of statistics by part is broadcast to the data it
# belongs to (its rows are counted first); a larger one has so many parts
# that the join deals the data out well.
BROADCAST_BYTES = 64 << 20
# Rank error of the sketch behind a quantile's bracket, as 1 / accuracy.
BRACKET_ACCURACY = 10_000
WHOLE_PARTS = 20_000
# Columns whose sketches one aggregate holds.
COLUMNS_AT_ONCE = 16


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, n)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the left side's key columns stay."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def with_part_stats(df: DataFrame, stats: DataFrame, part: list[str], row_bytes: int) -> DataFrame:
    """Add the statistics of each row's part: ``stats`` has one row a part.

    Without parts its only row enters as literals. Else the table is written
    once, its rows are counted, and it is broadcast when rows x ``row_bytes``
    is small, so the data is not dealt out by a few part keys.
    """
    if not part:
        row = stats.first()
        return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) if not isinstance(row[f.name], list)
                               else F.array(*[F.lit(x) for x in row[f.name]]).cast(f.dataType) for f in stats.schema.fields})
    table = cut_lineage(stats)
    if table.count() * row_bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return null_safe_join(df, table, part)


def _bucket(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_b``, the number of cuts in ``_cuts`` (sorted) strictly below the value."""
    out = df.withColumn("_b", F.lit(0))
    step = 1 << max(0, (buckets - 1).bit_length() - 1)
    while step:
        below = F.coalesce(F.get("_cuts", F.col("_b") + (step - 1)) < F.col(value), F.lit(False))
        out = out.withColumn("_b", F.when(below, F.col("_b") + step).otherwise(F.col("_b")))
        step //= 2
    return out.drop("_cuts")


def cumulative(df: DataFrame, part: list[str], value: str, weight: str | None = None,
               group: list[str] | None = None, buckets: int | None = None,
               accuracy: int | None = None, unique_by: list[str] | None = None,
               materialize: bool = False) -> DataFrame:
    """Rows ``(part, group, value, n)`` with, per row:

    ``_cum``   rows in the part with a value <= this one (all groups),
    ``_tie``   rows in the part with this exact value (all groups),
    ``_total`` rows in the part.

    NULL and NaN values are left out (they have no rank).

    With ``unique_by`` (columns that identify a row, e.g. a key) equal
    values are ordered by those columns, so every row gets its own position
    (``_tie`` is then the row's own count): a total order for ranking by a
    hash, where two keys may collide.

    The input is read for the cut points (a quantile sketch per part) and for
    the tie aggregation. For an expensive input (joins, an explode) pass
    ``materialize=True`` to write the needed columns once to the shared
    checkpoint folder first, so the lineage runs once and a lost executor
    does not recompute it from the source.
    """
    group = list(group or [])
    for u in unique_by or []:
        if u not in group:
            group.append(u)
    buckets = buckets or default_buckets(df)
    # Cut points only balance the buckets: a rank error of 1 / (20 buckets)
    # is plenty and keeps the quantile sketches small.
    accuracy = accuracy or max(200, 20 * buckets)
    w = F.col(weight) if weight else F.lit(1)
    src = df.where(present(df, value)).select(*part, *group, value, w.cast("bigint").alias("_w"))
    if materialize:
        src = cut_lineage(src)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = src.groupBy(*part).agg(F.percentile_approx(value, probs, accuracy).alias("_cuts"))
    ties = src.groupBy(*part, *group, value).agg(F.sum("_w").alias("n"))
    agg = _bucket(with_part_stats(ties, cuts, part, 8 * buckets + 64), value, buckets)

    wp = Window.partitionBy(*part) if part else Window.partitionBy()
    bt = agg.groupBy(*part, "_b").agg(F.sum("n").alias("_bn")).select(
        *part, "_b",
        F.coalesce(F.sum("_bn").over(wp.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(wp).alias("_total"))
    b = null_safe_join(agg, bt, [*part, "_b"])

    if unique_by:
        w_cum = (Window.partitionBy(*part, "_b").orderBy(value, *unique_by)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tie = F.col("n")
    else:
        w_cum = (Window.partitionBy(*part, "_b").orderBy(value)
                 .rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tie = F.sum("n").over(Window.partitionBy(*part, "_b", value))
    return b.select(*part, *group, value, "n",
                    (F.col("_off") + F.sum("n").over(w_cum)).alias("_cum"),
                    tie.alias("_tie"),
                    "_total")


def positions(df: DataFrame, part: list[str], value: str, unique_by: list[str]) -> DataFrame:
    """``df`` with ``_r``, the rows of its part up to each row in the order of
    ``value`` and ``unique_by``, and ``_first``, false for a row equal in all of
    them to an earlier one (they share ``_r``, the last one's place).

    As ``cumulative``, but the rows keep their columns and are dealt out once,
    by (part, bucket). Rows whose value is NULL or NaN are left out.
    """
    buckets = default_buckets(df)
    src = df.where(present(df, value))
    # Cuts only balance the buckets, so one row in 16, picked by hash, gives them; a part without any is one bucket.
    picked = src.where(F.pmod(F.xxhash64(F.lit("cuts"), value, *unique_by), F.lit(16)) == 0)
    cuts = picked.groupBy(*part).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(200, 20 * buckets)).alias("_cuts"))
    if part:
        cuts = null_safe_join(src.select(*part).distinct(), cuts, part, "left")
    rows = _bucket(with_part_stats(src, cuts, part, 8 * buckets + 64), value, buckets)
    before = F.sum("_n").over(Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    off = rows.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*part, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    run = Window.partitionBy("_b", *part).orderBy(value, *unique_by)
    rows = rows.withColumns({"_in": F.count(F.lit(1)).over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_first": F.rank().over(run) == F.row_number().over(run)})
    rows = with_part_stats(rows, off, [*part, "_b"], 64)
    return rows.select(*df.columns, (F.col("_off") + F.col("_in")).alias("_r"), "_first")


def present(df: DataFrame, col: str) -> Column:
    """Neither NULL nor, for a floating column, NaN (the other missing marker)."""
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) if dict(df.dtypes)[col] in ("double", "float") else c.isNotNull()


def midranks(df: DataFrame, part: list[str], value: str, group: list[str] | None = None,
             weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Average rank of each (part, group, value) block, ties averaged.

    Columns: part, group, value, n (rows in the block), tie (rows with that
    value in the part), midrank, total.
    """
    c = cumulative(df, part, value, weight, group, buckets)
    return c.select(*part, *(group or []), value, "n",
                    F.col("_tie").alias("tie"),
                    (F.col("_cum") - (F.col("_tie") - 1) / 2.0).alias("midrank"),
                    F.col("_total").alias("total"))


def rank_sums(df: DataFrame, part: list[str], group: str, value: str,
              buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Rank sum, size and tie term per (part, group).

    ``tie_term`` summed over the groups of a part gives sum(t^3 - t) over
    the distinct values of the part (each group adds its share n/t)."""
    r = midranks(df, part, value, [group], weight=weight, buckets=buckets)
    t = F.col("tie").cast("double")
    return (r.groupBy(*part, group)
             .agg(F.sum(F.col("n") * F.col("midrank")).alias("rank_sum"),
                  F.sum("n").alias("n"),
                  F.sum((t * t * t - t) * F.col("n") / t).alias("tie_term"),
                  F.first("total").alias("total")))


def exact_quantiles(df: DataFrame, part: list[str], value: str, probs: list[float],
                    names: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default, DuckDB's
    ``quantile_cont``), one row per part.

    A sketch with a rank error of at most n / accuracy gives, three errors
    below and above each wanted position, a bracket of values. A second pass
    counts the values below each bracket and groups those inside it, so about
    6 / accuracy of the values (and their ties, as one row each) are dealt
    out and ordered, in a window by part and position. Parts of fewer than
    ``WHOLE_PARTS`` rows, where an error is less than a few rows, are ordered
    whole. A bracket that did not hold its position would stop the job.
    """
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    src = df.where(present(df, value)).select(*part, F.col(value).cast("double").alias("_v"))
    err = 3.0 / BRACKET_ACCURACY
    edges = [x for p in probs for x in (max(0.0, p - err), min(1.0, p + err))]
    stats = src.groupBy(*part).agg(F.percentile_approx("_v", edges, BRACKET_ACCURACY).alias("_e"), F.count(F.lit(1)).alias("_n"))
    rows = with_part_stats(src, stats, part, 16 * len(edges) + 64)
    # The lowest and highest edges are open, so no position falls outside at the ends.
    low = [F.when(F.lit(p - err <= 0) | (F.col("_n") < WHOLE_PARTS), F.lit(float("-inf"))).otherwise(F.get("_e", F.lit(2 * i))) for i, p in enumerate(probs)]
    high = [F.when(F.lit(p + err >= 1) | (F.col("_n") < WHOLE_PARTS), F.lit(float("inf"))).otherwise(F.get("_e", F.lit(2 * i + 1))) for i, p in enumerate(probs)]
    inside = F.array_compact(F.array(*[F.when((F.col("_v") >= low[i]) & (F.col("_v") <= high[i]), F.lit(i)) for i in range(len(probs))]))
    below = [F.count(F.when(F.col("_v") < low[i], F.lit(1))).alias(f"_below{i}") for i in range(len(probs))]
    counts = rows.groupBy(*part).agg(F.first("_n").alias("n"), *below)
    held = (rows.select(*part, "_v", F.explode(inside).alias("_i")).groupBy(*part, "_i", "_v").agg(F.count(F.lit(1)).alias("_c")))
    run = Window.partitionBy(*part, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_end", F.sum("_c").over(run))
    if part:
        held = null_safe_join(held, counts, part)
    else:
        held = with_part_stats(held, counts, [], 0)
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("n") - 1)
        end = F.col(f"_below{i}") + F.col("_end")
        start = end - F.col("_c")
        here = F.col("_i") == i
        aggs += [F.max(F.when(here & (start <= lo) & (lo < end), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(here & (start <= hi) & (hi < end), F.col("_v"))).alias(f"_hi{i}"),
                 F.first(h - lo).alias(f"_fr{i}")]
    g = held.groupBy(*part).agg(*aggs, F.first("n").alias("n"))

    def quantile(i: int) -> Column:
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        lost = F.raise_error(F.lit("exact_quantiles: position outside its bracket")).cast("double")
        return F.when(lo.isNull() | hi.isNull(), lost).when((lo == hi) | (fr == 0), lo).otherwise(lo + fr * (hi - lo))

    return g.select(*part, "n", *[quantile(i).alias(nm) for i, nm in enumerate(names)])


def column_quantiles(df: DataFrame, part: list[str], cols: list[str], probs: list[float], names: list[str],
                     moments: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``(part, column, n, moments..., names...)``: exact quantiles, as
    ``exact_quantiles`` gives them, and other aggregates of many numeric columns.

    The frame stays wide: one aggregate takes the sketches and the ``moments``
    (double aggregates by name) of all columns, a second pass counts the values
    below each bracket, and only the values inside a bracket become rows of
    their own. Columns are taken in blocks, so that a task's sketches are
    few. NULL and NaN are left out; a part whose column has no value keeps its row,
    with n = 0 and NULL quantiles, and without parts an empty frame has one row a column.
    """
    blocks = [cols[i:i + COLUMNS_AT_ONCE] for i in range(0, len(cols), COLUMNS_AT_ONCE)]
    return reduce(DataFrame.unionByName, [_column_block(df, part, block, probs, names, moments or {}) for block in blocks])


def _column_block(df: DataFrame, part: list[str], cols: list[str], probs: list[float], names: list[str],
                  moments: dict[str, Callable[[Column], Column]]) -> DataFrame:
    n_cols, spots = range(len(cols)), [(i, k) for i in range(len(cols)) for k in range(len(probs))]
    src = df.select(*part, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)])
    err = 3.0 / BRACKET_ACCURACY
    edges = [x for p in probs for x in (max(0.0, p - err), min(1.0, p + err))]
    aggs = [a for i in n_cols for a in (F.count(f"_x{i}").alias(f"_n{i}"), F.percentile_approx(f"_x{i}", edges, BRACKET_ACCURACY).alias(f"_e{i}"))]
    sums = src.groupBy(*part).agg(*aggs, *[fn(F.col(f"_x{i}")).alias(f"_{m}{i}") for i in n_cols for m, fn in moments.items()])
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_e{i}").alias("_e"),
                               *[F.col(f"_{m}{i}").alias(m) for m in moments]) for i, c in enumerate(cols)])
    table = cut_lineage(sums.select(*part, cells.alias("_s")))
    brackets = table.select(*part, *[F.get("_s", F.lit(i))[x].alias(f"_{x.strip('_')}{i}") for i in n_cols for x in ("n", "_e")])
    if not part:
        rows = with_part_stats(src, brackets, [], 0)
    else:
        small = table.count() * len(cols) * (16 * len(edges) + 64) <= BROADCAST_BYTES
        rows = null_safe_join(src, F.broadcast(brackets) if small else brackets, part)

    def edge(i: int, k: int, high: int) -> Column:
        outer = probs[k] + err >= 1 if high else probs[k] - err <= 0
        return F.when(F.lit(outer) | (F.col(f"_n{i}") < WHOLE_PARTS), F.lit(float("inf" if high else "-inf"))) \
            .otherwise(F.get(f"_e{i}", F.lit(2 * k + high)))

    x = [F.col(f"_x{i}") for i in n_cols]
    counts = rows.groupBy(*part).agg(*[F.max(f"_n{i}").alias(f"_n{i}") for i in n_cols],
                                     *[F.count(F.when(x[i] < edge(i, k, 0), F.lit(1))).alias(f"_b{i}_{k}") for i, k in spots])
    spot = lambda i, k, *more: F.struct(F.lit(i).alias("_c"), F.lit(k).alias("_k"), *more)
    # The values below a bracket are one row before its values, so running counts start with them.
    below = counts.select(*part, F.explode(F.array(*[spot(i, k, F.lit(None).cast("double").alias("_v"), F.col(f"_b{i}_{k}").alias("_m"),
                                                          F.col(f"_n{i}").alias("_n")) for i, k in spots])).alias("_s")).select(*part, "_s.*")
    inside = F.array_compact(F.array(*[F.when((x[i] >= edge(i, k, 0)) & (x[i] <= edge(i, k, 1)), spot(i, k, x[i].alias("_v"))) for i, k in spots]))
    held = rows.select(*part, F.explode(inside).alias("_s")).select(*part, "_s.*").groupBy(*part, "_c", "_k", "_v").agg(F.count(F.lit(1)).alias("_m"))
    at = Window.partitionBy(*part, "_c", "_k")
    run = at.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("_n", F.lit(None).cast("bigint")).unionByName(below) \
        .withColumn("_end", F.sum("_m").over(run)).withColumn("_n", F.max("_n").over(at)).where(F.col("_v").isNotNull())
    h = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k")) * (F.col("_n") - 1)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("_n") - 1)
    start, end = F.col("_end") - F.col("_m"), F.col("_end")
    found = ranked.groupBy(*part, "_c", "_k").agg(F.max(F.when((start <= lo) & (lo < end), F.col("_v"))).alias("_lo"),
                                                  F.max(F.when((start <= hi) & (hi < end), F.col("_v"))).alias("_hi"), F.first(h - lo).alias("_fr"))
    low, high, fr = F.col("_lo"), F.col("_hi"), F.col("_fr")
    lost = F.raise_error(F.lit("column_quantiles: position outside its bracket")).cast("double")
    quantile = F.when(low.isNull() | high.isNull(), lost).when((low == high) | (fr == 0), low).otherwise(low + fr * (high - low))
    wide = found.withColumn("_q", quantile).groupBy(*part, "_c").agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(nm) for k, nm in enumerate(names)])
    base = table.select(*part, F.explode("_s").alias("_s")).select(*part, *[F.col("_s")[x].alias(x) for x in ("_c", "column", "n", *moments)])
    return null_safe_join(base, wide, [*part, "_c"], "left").select(*part, "column", "n", *moments, *names)


def fdr_bh(df: DataFrame, p: str = "p", family: list[str] | None = None,
           order_tie: list[str] | None = None, alpha: float = 0.05,
           out: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family.

    q_(i) = min_{j >= i} p_(j) m / j, capped at 1, over the tests that have a
    p-value; a NULL (or NaN) p takes no rank, does not count in m, and gets a
    NULL q and a NULL ``reject``. The input is a table of test results (one
    row per test), so its size is the number of tests.
    """
    family = family or []
    valid = present(df, p)
    tested = df.withColumn("_ok", valid)
    order = [F.col(p)] + [F.col(c) for c in (order_tie or [])]
    keys = [*family, "_ok"]
    w = Window.partitionBy(*keys).orderBy(*order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = tested.withColumn("_rank", F.row_number().over(w)).withColumn("_m", m)
    scaled = F.col(p) * F.col("_m") / F.col("_rank")
    tail = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    res = ranked.withColumn(out, F.when(F.col("_ok"), F.least(F.min(scaled).over(tail), F.lit(1.0))))
    return res.withColumn("reject", F.col(out) <= alpha).drop("_rank", "_m", "_ok")
