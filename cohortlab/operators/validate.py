"""Folds, splits, permutations and classification metrics
(W3, W4, M9, M11, M12, A13, A19).

Randomness is always ``xxhash64(seed, ..., key)``, never ``rand()``, so a
result does not depend on partitioning or on task retries after an
executor loss. Per-class orderings use the bucketed ranking of
``ranks.cumulative`` rather than a window over a whole class, which would
put a class (possibly a third of all rows) into a single task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .nulls import null_auc_from_counts
from .ranks import cumulative, null_safe_join, positions, rank_sums, with_part_stats


def _hash(seed: int, *cols) -> F.Column:
    return F.xxhash64(F.lit(seed), *cols)


def _md5(seed: int, *cols) -> F.Column:
    """60 bits of an MD5, which other engines can compute as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASHES = {"xxhash64": _hash, "md5": _md5}

# Cut points of text keys are these steps of a binary search over at most 4095 sampled keys.
TEXT_STEPS = [1 << i for i in range(11, -1, -1)]


def _key_order(df: DataFrame, key: str) -> F.Column:
    """A number that never falls as the key grows, for any kind of key; a NULL
    key comes first. A number stays itself; of a text it is how many of about
    3800 keys, sampled by hash, are below it, so that equal numbers are as
    rare as the keys are many, whatever the keys look like."""
    kind = dict(df.dtypes)[key]
    if kind in ("double", "float"):
        return F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    if kind != "string":
        return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    share = -(-df.count() // 3800) or 1
    some = df.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.lit("cuts"), key), F.lit(share)) == 0)).distinct().collect()
    cuts = sorted((r[0] for r in some), key=lambda k: k.encode())
    cuts = cuts[::-(-len(cuts) // 4095)] if cuts else cuts
    if not cuts:
        return F.lit(0)
    known = F.lit(cuts)
    return F.aggregate(F.lit(TEXT_STEPS), F.lit(0), lambda below, step: F.when(F.get(known, below + step - 1) < F.col(key), below + step).otherwise(below))


def class_rank(df: DataFrame, key: str, label: str, seed: int | None = 10,
               extra_part: list[str] | None = None) -> DataFrame:
    """1-based position of each key inside its class: in hash order
    (``seed`` given) or in key order (``seed=None``). Rows with a NULL label
    are a class of their own. Returns ``(extra_part, label, key, rank, class_n)``."""
    part = [*(extra_part or []), label]
    order = _hash(seed, F.col(key)) if seed is not None else _key_order(df, key)
    src = df.select(*part, key, order.alias("_o"))
    c = cumulative(src, part, "_o", unique_by=[key])
    return c.select(*part, key, F.col("_cum").alias("rank"), F.col("_total").alias("class_n"))


# Rows of a class in one bin of hashes, on average.
HASHED_ROWS = 16_384


def one_class_a_key(df: DataFrame, key: str, part: list[str]) -> bool:
    """Whether all rows of a key lie in the same class (columns ``part``)."""
    return key_kinds(df, key, part)[0]


def key_kinds(df: DataFrame, key: str, part: list[str]) -> tuple[bool, bool]:
    """Whether all rows of a key lie in the same class (columns ``part``), and whether no key has several rows."""
    cls = F.xxhash64(*[F.struct(F.col(c).isNull().alias("none"), F.col(c)) for c in part])
    each = df.select(F.col(key).alias("_k"), cls.alias("_c")).groupBy("_k").agg((F.min("_c") != F.max("_c")).alias("_split"), (F.count(F.lit(1)) > 1).alias("_twice"))
    row = each.agg(F.max("_split").alias("split"), F.max("_twice").alias("twice")).first()
    return not row["split"], not row["twice"]


def _hash_bins(n: int) -> Callable[[F.Column], F.Column]:
    """The bin of a hash: its first bits, as many as leave about ``HASHED_ROWS`` of ``n`` rows in a bin. Bins are in the order of the hashes."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / HASHED_ROWS)))
    return (lambda h: F.shiftright(h, 64 - bits)) if bits else (lambda h: F.lit(0).cast("bigint"))


def _below(counts: DataFrame, part: list[str]) -> DataFrame:
    """Counts ``_n`` by (part, _b) with ``_off``, the rows of the part in lower bins, and ``_total``."""
    run = Window.partitionBy(*part)
    before = F.sum("_n").over(run.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*part, "_b", "_n", F.coalesce(before, F.lit(0)).alias("_off"), F.sum("_n").over(run).alias("_total"))


def with_class_rank(df: DataFrame, key: str, part: list[str], seed: int, rank: str = "rank") -> DataFrame:
    """``df`` with each row's ``class_rank`` in hash order as column ``rank``; all
    rows of a key must lie in one class (``one_class_a_key``).

    Hashes are spread evenly, so their first bits are balanced buckets without
    a sketch. The rows themselves are dealt out by (class, bin) and keep their
    columns, so that no join by key brings the ranks back.
    """
    rows = df.withColumn("_h", _hash(seed, F.col(key)))
    rows = rows.withColumn("_b", _hash_bins(df.count())(F.col("_h")))
    off = _below(rows.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n")), part).select(*part, "_b", "_off")
    run = Window.partitionBy("_b", *part).orderBy("_h", key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_in", F.count(F.lit(1)).over(run))
    placed = with_part_stats(placed, off, [*part, "_b"], 64)
    return placed.select(*df.columns, (F.col("_off") + F.col("_in")).alias(rank))


def with_splits(df: DataFrame, key: str, label: str, train_size: float, seeds: list[int], name: Callable[[int], str]) -> DataFrame:
    """``df`` with a column ``name(seed)`` for each seed: 0 for the first
    floor(train_size * n_class) rows of each class in hash order, else 1.

    Where a split ends is one (hash, key) of each class: counts by bin of
    hashes tell its bin, and only the rows of that bin are ordered, so the table
    is read twice and dealt out never. All rows of a key must lie in one class.
    """
    bin_of = _hash_bins(df.count())
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), _hash(i, F.col(key)).alias("_h")) for i in seeds]))
    rows = df.select(F.col(label).alias("_l"), F.col(key).alias("_k"), marks.alias("_m")).select("_l", "_k", "_m.*").withColumn("_b", bin_of(F.col("_h")))
    taken = F.floor(F.col("_total") * F.lit(train_size))
    counts = _below(rows.groupBy("_l", "_i", "_b").agg(F.count(F.lit(1)).alias("_n")), ["_l", "_i"])
    last = counts.where((F.col("_off") <= taken) & (F.col("_off") + F.col("_n") > taken)).select("_l", "_i", "_b", (taken - F.col("_off")).alias("_left"))
    # One row a class and seed.
    edge = null_safe_join(rows, F.broadcast(cut_lineage(last)), ["_l", "_i", "_b"])
    run = Window.partitionBy("_l", "_i").orderBy("_h", "_k")
    edge = edge.withColumn("_in", F.count(F.lit(1)).over(run.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_in") > F.col("_left"))
    ends = edge.withColumn("_first", F.row_number().over(run)).where("_first = 1").select("_l", "_i", "_h", "_k").collect()
    kind = df.schema[key].dataType
    tests = {i: F.lit(0) for i in seeds}
    for e in ends:
        h = _hash(e["_i"], F.col(key))
        same = F.lit(True) if e["_k"] is None else F.coalesce(F.col(key) >= F.lit(e["_k"]).cast(kind), F.lit(False))
        behind = F.when(h == e["_h"], same).otherwise(h > e["_h"])
        tests[e["_i"]] = F.when(F.col(label).eqNullSafe(F.lit(e["_l"])), behind.cast("int")).otherwise(tests[e["_i"]])
    return df.select("*", *[tests[i].alias(name(i)) for i in seeds])


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10, seed: int | None = 10,
                     repeat: int = 0, name: str = "fold") -> DataFrame:
    """Fold id per key, stratified by label; class shares per fold differ
    by at most one row. ``seed=None`` keeps key order (unshuffled folds);
    repeated folds use a different ``repeat`` (mixed into the hash)."""
    s = None if seed is None else seed * 1000003 + repeat
    r = class_rank(df, key, label, s)
    return null_safe_join(df, r.select(key, ((F.col("rank") - 1) % k).cast("int").alias(name)), [key])


def stratified_split(df: DataFrame, key: str, label: str, train_size: float = 0.1,
                     seed: int | None = 0) -> DataFrame:
    """Per class the first floor(train_size * n_class) keys (hash order)
    are 'train', the rest 'test'."""
    r = class_rank(df, key, label, seed)
    split = F.when(F.col("rank") <= F.floor(F.col("class_n") * train_size), "train").otherwise("test")
    return null_safe_join(df, r.select(key, split.alias("split")), [key])


def permute_labels(df: DataFrame, key: str, label: str, seed: int = 0, name: str = "permuted",
                   by: list[str] | None = None, hash_name: str = "xxhash64") -> DataFrame:
    """A random permutation of the label column over the keys, within each group ``by``.

    The row at position r in key order receives the label of the row at
    position r in hash order; both positions come from distributed ranks
    and meet in one equi-join on r (no shuffle of a single partition). A NULL
    key is a key like any other and comes first."""
    by = by or []
    by_key = positions(df.withColumn("_o", _key_order(df, key)), by, "_o", [key]).drop("_o", "_first")
    order = HASHES[hash_name](seed, *[F.col(c) for c in by], F.col(key))
    by_hash = positions(df.select(*by, key, label, order.alias("_o")), by, "_o", [key, label]) \
        .where("_first").select(*by, F.col(label).alias(name), "_r")
    return null_safe_join(by_key, by_hash, ["_r", *by]).select(*df.columns, name)


def auc_exact(df: DataFrame, label: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """M9: exact ROC AUC from mid-ranks (Mann-Whitney), per group ``by``;
    a row with ``weight`` n counts as n rows."""
    by = by or []
    rs = rank_sums(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()), by, label, score, weight=weight)
    pos = F.col(label) == 1
    g = rs.groupBy(*by).agg(F.sum(F.when(pos, F.col("rank_sum"))).alias("R1"),
                            F.sum(F.when(pos, F.col("n"))).cast("double").alias("n1"),
                            F.sum(F.when(~pos, F.col("n"))).cast("double").alias("n0"))
    auc = F.try_divide(F.col("R1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
    return g.select(*by, auc.alias("auc"))


def classification_metrics(df: DataFrame, label: str, prob: str, by: list[str] | None = None,
                           threshold: float = 0.5, pred: str | None = None, weight: str | None = None) -> DataFrame:
    """M9: AUC, accuracy, balanced accuracy, sensitivity, specificity,
    weighted F1, PPV, NPV and Brier score per group, from one grouped
    aggregate (confusion counts, squared error) plus the exact AUC. A row
    with ``weight`` n counts as n rows."""
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("int")
    yhat = F.col(pred).cast("int") if pred else (F.col(prob) >= threshold).cast("int")
    c = df.groupBy(*by).agg(
        F.sum(((y == 1) & (yhat == 1)).cast("double") * w).alias("tp"),
        F.sum(((y == 0) & (yhat == 1)).cast("double") * w).alias("fp"),
        F.sum(((y == 0) & (yhat == 0)).cast("double") * w).alias("tn"),
        F.sum(((y == 1) & (yhat == 0)).cast("double") * w).alias("fn"),
        F.try_divide(F.sum((F.col(prob) - y) * (F.col(prob) - y) * w),
                     F.sum(F.when((F.col(prob) - y).isNotNull(), w))).alias("brier"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    # try_divide: an empty class in a group gives NULL, not a failed job.
    sens = F.try_divide(tp, tp + fn)
    spec = F.try_divide(tn, tn + fp)
    f1_pos = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    f1_neg = F.when(2 * tn + fn + fp > 0, 2 * tn / (2 * tn + fn + fp)).otherwise(0.0)
    m = c.select(*by,
                 F.try_divide(tp + tn, n).alias("accuracy"),
                 ((sens + spec) / 2.0).alias("balanced_accuracy"),
                 sens.alias("sensitivity"), spec.alias("specificity"),
                 F.try_divide(f1_pos * (tp + fn) + f1_neg * (tn + fp), n).alias("f1_weighted"),
                 F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("ppv"),
                 F.when(tn + fn > 0, tn / (tn + fn)).otherwise(0.0).alias("npv"),
                 "brier")
    a = auc_exact(df, label, prob, by, weight)
    if by:
        return null_safe_join(a, m, by)
    # Both sides are one row: the AUC enters as a literal (no cross join).
    return m.select(F.lit(a.first()["auc"]).cast("double").alias("auc"), *m.columns)


METRICS = ["auc", "accuracy", "balanced_accuracy", "sensitivity", "specificity",
           "f1_weighted", "ppv", "npv", "brier"]


def metrics_long(metrics: DataFrame, by: list[str], split: str = "test") -> DataFrame:
    """Metrics table to long ``(by..., split, metric, score)``."""
    cols = [c for c in METRICS if c in metrics.columns]
    return metrics.select(*by, *[F.col(c).cast("double") for c in cols]) \
        .unpivot(by, cols, "metric", "score").withColumn("split", F.lit(split))


def cv_score_summary(scores: DataFrame, metric: str = "metric", split: str = "split",
                     score: str = "score", digits: int = 4, negated=("brier",)) -> DataFrame:
    """|mean * 100| and |sd * 100| (n - 1) per metric and split,
    rounded; negated losses (Brier) are reported back on the 0-1 scale."""
    g = scores.groupBy(metric, split).agg(
        F.abs(F.avg(score) * 100.0).alias("mean"), F.abs(F.stddev_samp(score) * 100.0).alias("std"))
    back = F.col(metric).isin(list(negated))
    return g.select(metric, split,
                    F.when(back, F.bround("mean", digits) / 100.0).otherwise(F.bround("mean", digits)).alias("mean"),
                    F.when(back, F.bround("std", digits) / 100.0).otherwise(F.bround("std", digits)).alias("std"))


def perm_pvalue(null: DataFrame, score: str, true_score: float) -> DataFrame:
    """Exceedance count k of a null distribution and p = (k+1)/(n+1)."""
    g = null.agg(F.count(F.when(F.col(score) >= F.lit(true_score), 1)).alias("n_exceed"),
                 F.count(score).alias("n_null"))
    return g.select("n_exceed", "n_null",
                    ((F.col("n_exceed") + 1.0) / (F.col("n_null") + 1.0)).alias("p_value"))


# Rows of one permutation that are ordered in one window, on average.
ORDERED_ROWS = 4096


def permutation_null_auc(df: DataFrame, key: str, label: str, score: str,
                         n_permutations: int, seed: int = 0, hash_name: str = "xxhash64") -> DataFrame:
    """M11 (scale mode): null distribution of the AUC of fixed scores under
    permuted labels. In permutation b the positives are the n1 keys first in
    ``xxhash64(seed, b, key)`` order, and the AUC follows from their rank sum.
    Returns ``(perm, auc)``.

    Scores are ranked once, as a table of distinct scores. Hash values are cut
    into bins by their first bits; counts and rank sums by (permutation, bin)
    are summed in the tasks, and tell in which bin the n1-th key of each
    permutation lies. Only that bin's rows (about ``ORDERED_ROWS`` for each
    permutation) are ordered: no rows x permutations table is stored or dealt
    out.
    """
    base = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(key, label, F.col(score).cast("double").alias("_s"))
    ties = cumulative(base.select("_s"), [], "_s")
    mid = ties.select("_s", (F.col("_cum") - (F.col("_tie") - 1) / 2.0).alias("mid"))
    ranked = cut_lineage(base.join(mid, "_s").select(key, label, "mid"))
    counts = ranked.agg(F.sum(F.col(label).cast("long")).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n = int(counts["n1"] or 0), int(counts["n"])
    n0 = n - n1
    bits = max(0, math.ceil(math.log2(max(n, 1) / ORDERED_ROWS)))
    rows = ranked.select(key, "mid", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("perm"))
    rows = rows.withColumn("_h", HASHES[hash_name](seed, F.col("perm"), F.col(key)))
    rows = rows.withColumn("_bin", F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    run = Window.partitionBy("perm").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("perm", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("mid").alias("_m"))
    bins = bins.select("perm", "_bin", "_n", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"),
                       F.coalesce(F.sum("_m").over(run), F.lit(0.0)).alias("_sum"))
    last = bins.where((F.col("_before") < n1) & (F.col("_before") + F.col("_n") >= n1)).select("perm", "_bin", "_before", "_sum")
    # One row a permutation: the number of permutations is a parameter.
    edge = rows.join(F.broadcast(last), ["perm", "_bin"])
    place = F.row_number().over(Window.partitionBy("perm").orderBy("_h", key))
    edge = edge.withColumn("_place", place).where(F.col("_place") + F.col("_before") <= n1)
    auc = (F.first("_sum") + F.sum("mid") - F.lit(n1 * (n1 + 1) / 2.0)) / F.lit(float(max(n1 * n0, 1)))
    return edge.groupBy("perm").agg(auc.alias("auc"))


def permutation_test(df: DataFrame, key: str, label: str, score: str, true_score: float | None = None,
                     n_permutations: int = 1000, seed: int = 0, hash_name: str = "xxhash64",
                     draw: str = "counts") -> DataFrame:
    """p = (k + 1) / (n + 1) with k null AUCs >= the true AUC.

    ``draw="counts"`` draws the positives of each distinct score (``nulls``);
    ``draw="keys"`` orders the keys by ``hash_name``, which other engines can repeat."""
    if draw == "counts":
        null = null_auc_from_counts(df, label, score, n_permutations, seed)
    elif draw == "keys":
        null = permutation_null_auc(df, key, label, score, n_permutations, seed, hash_name)
    else:
        raise ValueError(draw)
    if true_score is None:
        true_score = auc_exact(df, label, score).first()["auc"]
    return perm_pvalue(null, "auc", true_score).withColumn("true_auc", F.lit(float(true_score)))
