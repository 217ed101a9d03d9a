"""Registered queries: metrics, folds, permutations and figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures as FG
from ..operators import nulls as N
from ..operators import validate as V
from ..session import cut_lineage
from . import fixtures as FX
from .fixtures import with_views
from .registry import query
from .sqlgen import midrank_sql, r, rounded, union

N_FOLDS = 10


def _auc_sql(src: str, part: list[str], label: str = "label", score: str = "prob") -> str:
    ranks = midrank_sql(src, score, part, [label])
    p = ", ".join(part)
    return (f"SELECT {p + ', ' if part else ''}(sum(_mid) FILTER (WHERE {label} = 1) - "
            f"n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM (SELECT *, "
            f"CAST(count(*) FILTER (WHERE {label} = 1) OVER ({'PARTITION BY ' + p if part else ''}) AS DOUBLE) AS n1, "
            f"CAST(count(*) FILTER (WHERE {label} = 0) OVER ({'PARTITION BY ' + p if part else ''}) AS DOUBLE) AS n0 "
            f"FROM {ranks} x) y {('GROUP BY ' + p + ', n1, n0') if part else 'GROUP BY n1, n0'}")


def _metrics_sql(src: str, part: list[str]) -> str:
    p = ", ".join(part)
    cm = (f"SELECT {p}, CAST(count(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS DOUBLE) AS tp, "
          f"CAST(count(*) FILTER (WHERE label = 0 AND prob >= 0.5) AS DOUBLE) AS fp, "
          f"CAST(count(*) FILTER (WHERE label = 0 AND prob < 0.5) AS DOUBLE) AS tn, "
          f"CAST(count(*) FILTER (WHERE label = 1 AND prob < 0.5) AS DOUBLE) AS fn, "
          f"avg((prob - label) * (prob - label)) AS brier FROM {src} GROUP BY {p}")
    f1p = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"
    f1n = "CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END"
    on = " AND ".join(f"a.{c} = m.{c}" for c in part)
    return (f"SELECT {', '.join('m.' + c for c in part)}, a.auc, (tp + tn) / (tp + fp + tn + fn) AS accuracy, "
            f"(tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, tp / (tp + fn) AS sensitivity, "
            f"tn / (tn + fp) AS specificity, (({f1p}) * (tp + fn) + ({f1n}) * (tn + fp)) / (tp + fp + tn + fn) "
            f"AS f1_weighted, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS ppv, "
            f"CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS npv, brier "
            f"FROM ({cm}) m JOIN ({_auc_sql(src, part)}) a ON {on}")


def _round_cols(sql: str, cols: list[str], keep: list[str]) -> str:
    return f"SELECT {', '.join(keep)}, " + ", ".join(f"{r(c)} AS {c}" for c in cols) + f" FROM ({sql}) q"


@query("auc_exact", "M9 W1", sql=with_views(_round_cols(_auc_sql("f_scored", ["fold"]), ["auc"], ["fold"]),
                                            "f_scored"))
def auc_exact(spark, sf_dir):
    return rounded(V.auc_exact(FX.f_scored(spark, sf_dir), "label", "prob", ["fold"]))


@query("brier", "M9", sql=with_views(
    f"SELECT fold, {r('avg((prob - label) * (prob - label))')} AS brier FROM f_scored GROUP BY fold", "f_scored"))
def brier(spark, sf_dir):
    m = V.classification_metrics(FX.f_scored(spark, sf_dir), "label", "prob", ["fold"])
    return rounded(m.select("fold", "brier"))


@query("classification_metrics", "M9 M13", sql=with_views(
    _round_cols(_metrics_sql("f_scored", ["fold"]), V.METRICS, ["fold"]), "f_scored"))
def classification_metrics(spark, sf_dir):
    return rounded(V.classification_metrics(FX.f_scored(spark, sf_dir), "label", "prob", ["fold"]))


SCORED_TWO = ("(SELECT 'prob' AS model, fold, label, prob FROM f_scored UNION ALL "
              "SELECT 'prob_coarse' AS model, fold, label, floor(prob * 10) / 10 AS prob FROM f_scored)")


def _two_models(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir)
    return s.select(F.lit("prob").alias("model"), "fold", "label", "prob").unionByName(
        s.select(F.lit("prob_coarse").alias("model"), "fold", "label",
                 (F.floor(F.col("prob") * 10) / 10).alias("prob")))


@query("errorbar_scores", "A12", sql=with_views(
    f"SELECT model, count(auc) AS n, {r('avg(auc)')} AS mean, {r('stddev_pop(auc)')} AS sd FROM ("
    + _auc_sql(SCORED_TWO, ["model", "fold"]) + ") a GROUP BY model", "f_scored"))
def errorbar_scores(spark, sf_dir):
    per_fold = V.auc_exact(_two_models(spark, sf_dir), "label", "prob", ["model", "fold"])
    return rounded(FG.errorbar_scores(per_fold, "model", "auc"))


def _train_rows_sql() -> str:
    return ("(SELECT k.f AS fold, s.label, s.prob FROM f_scored s JOIN "
            "(SELECT CAST(range AS INTEGER) AS f FROM range(10)) k ON s.fold <> k.f)")


def _summary_sql() -> str:
    metrics = V.METRICS
    longs = []
    for split, src in (("test", "f_scored"), ("train", _train_rows_sql())):
        m = _metrics_sql(src, ["fold"])
        longs.append(union([f"SELECT fold, '{split}' AS split, '{c}' AS metric, {c} AS score FROM ({m}) q{i}"
                            for i, c in enumerate(metrics)]))
    long = union(longs)
    mean = "round_even(abs(avg(score) * 100), 4)"
    sd = "round_even(abs(stddev_samp(score) * 100), 4)"
    return with_views(
        f"SELECT metric, split, {r(f'CASE WHEN metric = {chr(39)}brier{chr(39)} THEN {mean} / 100 ELSE {mean} END')} "
        f"AS mean, {r(f'CASE WHEN metric = {chr(39)}brier{chr(39)} THEN {sd} / 100 ELSE {sd} END')} AS std "
        f"FROM ({long}) l GROUP BY metric, split", "f_scored")


@query("cv_score_summary", "A13 C13 M9", sql=_summary_sql())
def cv_score_summary(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir)
    test = V.metrics_long(V.classification_metrics(s, "label", "prob", ["fold"]), ["fold"], "test")
    # Training rows of outer fold k are all rows outside k: each distinct
    # (label, score) of a fold, with its count, joins the other nine folds.
    others = F.filter(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)), lambda f: f != F.col("fold"))
    counted = s.groupBy("fold", "label", "prob").agg(F.count(F.lit(1)).alias("n"))
    train_rows = counted.select(F.explode(others).alias("fold"), "label", "prob", "n")
    train = V.metrics_long(V.classification_metrics(train_rows, "label", "prob", ["fold"], weight="n"), ["fold"], "train")
    return rounded(V.cv_score_summary(test.unionByName(train)))


@query("histogram_by_group", "A16", sql=with_views(
    "SELECT outcome, bin, " + r("lo + bin * w") + " AS \"left\", " + r("lo + (bin + 1) * w") + " AS \"right\", "
    "count(*) AS n, " + r("count(*) / (max(nn) * w)") + " AS density FROM ("
    "SELECT f.outcome, CAST(least(floor((f.o_totalprice - g.lo) / (g.hi - g.lo) * 25), 24) AS INTEGER) AS bin, "
    "g.lo, (g.hi - g.lo) / 25 AS w, g.nn FROM f_cohort f JOIN (SELECT outcome, min(o_totalprice) AS lo, "
    "max(o_totalprice) AS hi, count(o_totalprice) AS nn FROM f_cohort GROUP BY outcome) g "
    "ON f.outcome = g.outcome WHERE f.o_totalprice IS NOT NULL) b GROUP BY outcome, bin, lo, w", "f_cohort"))
def histogram_by_group(spark, sf_dir):
    return rounded(FG.histogram_by_group(FX.staged(FX.f_cohort(spark, sf_dir)), "o_totalprice", "outcome", 25))


@query("kde_by_group", "A17", sql=with_views(
    "SELECT outcome, point, " + r("lo + (hi - lo) / 63 * point") + " AS x, "
    + r("sum(exp(-0.5 * ((lo + (hi - lo) / 63 * point - v) / h) * ((lo + (hi - lo) / 63 * point - v) / h))) "
        "/ (max(n) * max(h) * sqrt(2 * pi()))") + " AS density FROM ("
    "SELECT f.outcome, CAST(f.avg_qty AS DOUBLE) AS v, g.lo, g.hi, g.n, pow(g.n, -0.2) * g.sd AS h "
    "FROM f_cohort f JOIN (SELECT outcome, min(avg_qty) AS lo, max(avg_qty) AS hi, count(avg_qty) AS n, "
    "stddev_samp(avg_qty) AS sd FROM f_cohort GROUP BY outcome) g ON f.outcome = g.outcome "
    "WHERE f.avg_qty IS NOT NULL) d, (SELECT CAST(range AS INTEGER) AS point FROM range(64)) p "
    "GROUP BY outcome, point, lo, hi", "f_cohort"))
def kde_by_group(spark, sf_dir):
    return rounded(FG.kde_by_group(FX.staged(FX.f_cohort(spark, sf_dir)), "avg_qty", "outcome", grid=64))


PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
STATUS_LEVELS = ["F", "O", "P"]


@query("ordered_counts", "A18", sql=(
    "SELECT CAST(o.position AS INTEGER) AS position, o.o_orderpriority, s.o_orderstatus, "
    "CAST(count(x.o_orderkey) AS BIGINT) AS n FROM (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{v}')" for i, v in enumerate(PRIORITY_ORDER))
    + ") AS t(position, o_orderpriority)) o CROSS JOIN (SELECT * FROM (VALUES "
    + ", ".join(f"('{v}')" for v in STATUS_LEVELS) + ") AS u(o_orderstatus)) s "
    "LEFT JOIN orders x ON x.o_orderpriority = o.o_orderpriority AND x.o_orderstatus = s.o_orderstatus "
    "GROUP BY o.position, o.o_orderpriority, s.o_orderstatus"))
def ordered_counts(spark, sf_dir):
    return FG.ordered_counts(FX.t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus",
                             PRIORITY_ORDER, STATUS_LEVELS)


@query("perm_pvalue", "A19", sql=with_views(
    "SELECT count(*) FILTER (WHERE m >= t) AS n_exceed, count(m) AS n_null, "
    + r("(count(*) FILTER (WHERE m >= t) + 1.0) / (count(m) + 1.0)") + " AS p_value FROM "
    "(SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) n, "
    "(SELECT avg(o_totalprice) AS t FROM f_cohort WHERE outcome = 1) s", "f_cohort"))
def perm_pvalue(spark, sf_dir):
    null = FX.t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    true = FX.f_cohort(spark, sf_dir).where(F.col("outcome") == 1).agg(F.avg("o_totalprice")).first()[0]
    return rounded(V.perm_pvalue(null, "m", true))


@query("stratified_folds", "W3", sql=with_views(
    "SELECT o_orderkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY o_orderkey) - 1) % 10 "
    "AS INTEGER) AS cv_fold FROM f_scored", "f_scored"))
def stratified_folds(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir).select("o_orderkey", "label")
    return V.stratified_folds(s, "o_orderkey", "label", k=10, seed=None, name="cv_fold")


@query("stratified_split", "M12", sql=with_views(
    "SELECT o_orderkey, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY o_orderkey) "
    "<= floor(count(*) OVER (PARTITION BY label) * 0.1) THEN 'train' ELSE 'test' END AS split FROM f_scored",
    "f_scored"))
def stratified_split(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir).select("o_orderkey", "label")
    return V.stratified_split(s, "o_orderkey", "label", train_size=0.1, seed=None)


@query("ordered_counts_default", "A18", sql=(
    "SELECT CAST(o.position AS INTEGER) AS position, o.o_orderpriority, s.o_orderstatus, CAST(count(x.o_orderkey) AS BIGINT) AS n FROM "
    "(SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS position FROM (SELECT DISTINCT o_orderpriority FROM orders) d) o CROSS JOIN (SELECT * FROM (VALUES "
    + ", ".join(f"('{v}')" for v in STATUS_LEVELS) + ") AS u(o_orderstatus)) s "
    "LEFT JOIN orders x ON x.o_orderpriority = o.o_orderpriority AND x.o_orderstatus = s.o_orderstatus GROUP BY o.position, o.o_orderpriority, s.o_orderstatus"))
def ordered_counts_default(spark, sf_dir):
    return FG.ordered_counts(FX.t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", None, STATUS_LEVELS)


# Keys that differ only in their last characters, one that begins otherwise, and NULL.
_TEXT_KEYS = ("(SELECT CASE WHEN o_orderkey % 1000 = 7 THEN 'A' || o_orderkey WHEN o_orderkey = 1 THEN NULL ELSE 'subject_with_a_long_name_' || o_orderkey END AS subject, label FROM f_scored)")


def _text_keys(spark, sf_dir):
    return FX.f_scored(spark, sf_dir).select(F.expr("CASE WHEN o_orderkey % 1000 = 7 THEN concat('A', o_orderkey) WHEN o_orderkey = 1 THEN NULL ELSE concat('subject_with_a_long_name_', o_orderkey) END").alias("subject"), "label")


@query("stratified_folds_text_key", "W3", sql=with_views(
    "SELECT subject, label, CAST((row_number() OVER (PARTITION BY label ORDER BY subject NULLS FIRST) - 1) % 10 AS INTEGER) AS cv_fold FROM " + _TEXT_KEYS + " k", "f_scored"))
def stratified_folds_text_key(spark, sf_dir):
    return V.stratified_folds(cut_lineage(_text_keys(spark, sf_dir)), "subject", "label", k=10, seed=None, name="cv_fold")


@query("permute_labels_md5", "W4", sql=with_views(
    "SELECT a.subject, a.label, b.label AS permuted FROM (SELECT *, row_number() OVER (ORDER BY subject NULLS FIRST) AS r FROM " + _TEXT_KEYS + " k) a JOIN "
    "(SELECT label, row_number() OVER (ORDER BY substr(md5(concat_ws(':', '7', subject)), 1, 15), subject NULLS FIRST) AS r FROM " + _TEXT_KEYS + " k) b ON a.r = b.r", "f_scored"))
def permute_labels_md5(spark, sf_dir):
    """The permutation with a hash that SQL can compute as well."""
    return V.permute_labels(cut_lineage(_text_keys(spark, sf_dir)), "subject", "label", seed=7, hash_name="md5")


N_MD5 = 20


@query("permutation_test_md5", "T10 M11", sql=with_views(
    f", ranked AS (SELECT o_orderkey, label, mid FROM (SELECT o_orderkey, label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS mid FROM f_scored WHERE label IS NOT NULL AND prob IS NOT NULL) m), "
    "z AS (SELECT sum(label) AS n1, count(*) - sum(label) AS n0 FROM ranked), "
    f"drawn AS (SELECT perm, mid, row_number() OVER (PARTITION BY perm ORDER BY substr(md5('3:' || perm || ':' || o_orderkey), 1, 15), o_orderkey) AS place FROM ranked, range({N_MD5}) t(perm)), "
    "null_ AS (SELECT perm, (sum(mid) - max(n1) * (max(n1) + 1) / 2.0) / (max(n1) * max(n0)) AS auc FROM drawn, z WHERE place <= n1 GROUP BY perm), "
    "truth AS (SELECT (sum(mid) FILTER (WHERE label = 1) - max(n1) * (max(n1) + 1) / 2.0) / (max(n1) * max(n0)) AS t FROM ranked, z) "
    "SELECT count(*) FILTER (WHERE auc >= t) AS n_exceed, count(*) AS n_null, " + r("(count(*) FILTER (WHERE auc >= t) + 1.0) / (count(*) + 1.0)") + " AS p_value, "
    + r("max(t)") + " AS true_auc FROM null_, truth", "f_scored").replace("\n, ranked AS", ", ranked AS"))
def permutation_test_md5(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir)
    return rounded(V.permutation_test(s, "o_orderkey", "label", "prob", n_permutations=N_MD5, seed=3, hash_name="md5", draw="keys"))


@query("permute_labels", "W4")
def permute_labels(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir).select("o_orderkey", "label")
    return V.permute_labels(s, "o_orderkey", "label", seed=7)


# The study's number of permutations.
N_STUDY = 10000


@query("permutation_test", "T10 M11")
def permutation_test(spark, sf_dir):
    s = FX.f_scored(spark, sf_dir)
    return V.permutation_test(s, "o_orderkey", "label", "prob", n_permutations=N_STUDY, seed=3)


@query("permutation_null_moments", "T10 M11", sql=with_views(
    f"SELECT CAST(sum(y) AS BIGINT) AS n1, CAST(sum(t) - sum(y) AS BIGINT) AS n0, CAST({N_STUDY} AS BIGINT) AS n_null, "
    "round((sum(t) + 1 - sum(t * t * t - t) / (sum(t) * (sum(t) - 1))) / (12 * sum(y) * (sum(t) - sum(y))), 12) AS variance, "
    "true AS mean_fits, true AS variance_fits FROM (SELECT prob, CAST(count(*) AS DOUBLE) AS t, CAST(sum(label) AS DOUBLE) AS y "
    "FROM f_scored WHERE label IS NOT NULL AND prob IS NOT NULL GROUP BY prob) g", "f_scored"))
def permutation_null_moments(spark, sf_dir):
    """Mean and variance of the drawn null against their closed forms, within five standard errors."""
    s = FX.f_scored(spark, sf_dir)
    null = N.null_auc_from_counts(s, "label", "prob", N_STUDY, seed=3)
    drawn = null.agg(F.count("auc").alias("n"), F.avg("auc").alias("m"), F.var_samp("auc").alias("v")).first()
    v = F.col("variance")
    return N.null_variance(s, "label", "prob").select(
        "n1", "n0", F.lit(drawn["n"]).cast("bigint").alias("n_null"), F.round(v, 12).alias("variance"),
        (F.abs(F.lit(drawn["m"]) - 0.5) < 5 * F.sqrt(v / N_STUDY)).alias("mean_fits"),
        (F.abs(F.lit(drawn["v"]) / v - 1) < 5 * (2 / N_STUDY) ** 0.5).alias("variance_fits"))
