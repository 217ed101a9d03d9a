"""Registered queries: design matrices, regression, imputation, scaling,
feature selection, classifiers and nested cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.scalar import aic
from ..operators import cv as CV
from ..operators import models as M
from ..operators import pipeline as PL
from ..operators import rows as R
from ..operators import stattests as ST
from ..operators.design import design_matrix as build_design
from ..session import cut_lineage, scratch_path
from . import fixtures as FX
from .fixtures import with_views
from .q_stats import _anova_sql
from .registry import query
from .sqlgen import r, rounded

DESIGN_TERMS = ["l_quantity", "C(l_returnflag)", "l_discount*C(l_linestatus)"]


@query("design_matrix", "R1", sql=(
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, "
    "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS l_returnflag_T_N, "
    "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS l_returnflag_T_R, "
    "CAST(l_discount AS DOUBLE) AS l_discount, "
    "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS l_linestatus_T_O, "
    "l_discount * CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS l_discount_x_l_linestatus_T_O "
    "FROM lineitem"))
def design_matrix(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    out, _, _ = build_design(li, DESIGN_TERMS, keep=["l_orderkey", "l_linenumber"])
    return out


def _two_by_two() -> str:
    return ("(SELECT CAST(count(*) FILTER (WHERE flag_disc = 1 AND outcome = 1) AS DOUBLE) AS a, "
            "CAST(count(*) FILTER (WHERE flag_disc = 1 AND outcome = 0) AS DOUBLE) AS b, "
            "CAST(count(*) FILTER (WHERE flag_disc = 0 AND outcome = 1) AS DOUBLE) AS c, "
            "CAST(count(*) FILTER (WHERE flag_disc = 0 AND outcome = 0) AS DOUBLE) AS d FROM f_flags)")


def _logit_sql() -> str:
    rows = ("SELECT 'Intercept' AS term, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM t UNION ALL "
            "SELECT 'flag_disc' AS term, ln(a * d / (b * c)) AS coef, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se "
            "FROM t")
    z = "coef / se"
    return with_views(
        f", t AS {_two_by_two()} SELECT term, {r('coef')} AS coef, {r('se')} AS se, {r(z)} AS z, "
        f"{r('2 * ' + D.sql_norm_sf(f'abs({z})'))} AS p, {r(f'coef - {M.Z975} * se')} AS lo, "
        f"{r(f'coef + {M.Z975} * se')} AS hi FROM ({rows}) x", "f_flags").replace("\n, t AS", ", t AS")


@query("logit_fit", "R2", sql=_logit_sql())
def logit_fit(spark, sf_dir):
    table, _ = M.logit_fit(FX.f_flags(spark, sf_dir), "outcome", ["flag_disc"])
    return rounded(table.drop("status"))


@query("aic_expr", "C15 R2", sql=with_views(
    f", t AS {_two_by_two()} SELECT {r('llf')} AS llf, CAST(2 AS BIGINT) AS k, {r('-2 * llf + 2 * 2')} AS aic "
    "FROM (SELECT a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) "
    "AS llf FROM t) x", "f_flags").replace("\n, t AS", ", t AS"))
def aic_expr(spark, sf_dir):
    _, st = M.logit_fit(FX.f_flags(spark, sf_dir), "outcome", ["flag_disc"])
    one = spark.createDataFrame([(st["llf"], st["k"])], "llf double, k bigint")
    return rounded(one.select("llf", "k", aic(F.col("llf"), F.col("k")).alias("aic")))


def _ols_sql() -> str:
    s = ("SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b1, "
         "regr_intercept(l_extendedprice, l_quantity) AS b0, regr_r2(l_extendedprice, l_quantity) AS r2, "
         "regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, "
         "avg(l_quantity) AS mx FROM lineitem")
    e = ("SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM s")
    rows = ("SELECT 'Intercept' AS term, b0 AS coef, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, r2, n FROM e "
            "UNION ALL SELECT 'l_quantity' AS term, b1 AS coef, sqrt(s2 / sxx) AS se, r2, n FROM e")
    return (f"WITH s AS ({s}), e AS ({e}) SELECT term, {r('coef')} AS coef, {r('se')} AS se, "
            f"{r('coef / se')} AS t, {r(D.sql_t_sf_two_sided('coef / se', '(n - 2)'))} AS p, {r('r2')} AS r2 "
            f"FROM ({rows}) x")


@query("ols_fit", "R3", sql=_ols_sql())
def ols_fit(spark, sf_dir):
    table, st = M.ols_fit(FX.t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(table.withColumn("r2", F.lit(st["r2"])))


def _ols_aliased_sql() -> str:
    s = ("SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, "
         "covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_discount) AS c2, var_pop(l_extendedprice) AS vy FROM lineitem")
    b = "SELECT *, v1 * v2 - c12 * c12 AS det, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s"
    e = "SELECT *, n * (vy - b1 * c1 - b2 * c2) / (n - 3) / n AS q, 1 - (vy - b1 * c1 - b2 * c2) / vy AS r2 FROM b"
    rows = ("SELECT 'Intercept' AS term, my - b1 * m1 - b2 * m2 AS coef, sqrt(q * (1 + (m1 * m1 * v2 - 2 * m1 * m2 * c12 + m2 * m2 * v1) / det)) AS se, r2, n FROM e UNION ALL "
            "SELECT 'l_quantity', b1, sqrt(q * v2 / det), r2, n FROM e UNION ALL SELECT 'l_discount', b2, sqrt(q * v1 / det), r2, n FROM e UNION ALL "
            "SELECT 'twice', NULL, NULL, r2, n FROM e")
    return (f"WITH s AS ({s}), b AS ({b}), e AS ({e}) SELECT term, {r('coef')} AS coef, {r('se')} AS se, {r('coef / se')} AS t, "
            f"CASE WHEN coef IS NOT NULL THEN {r(D.sql_t_sf_two_sided('coef / se', '(n - 3)'))} END AS p, {r('r2')} AS r2 FROM ({rows}) x")


@query("ols_aliased", "R3", sql=_ols_aliased_sql())
def ols_aliased(spark, sf_dir):
    """Two predictors, and a third that is a combination of the first and the intercept."""
    li = FX.t(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1)
    table, st = M.ols_fit(li, "l_extendedprice", ["l_quantity", "l_discount", "twice"])
    return rounded(table.withColumn("r2", F.lit(st["r2"])))


@query("logit_separated", "R2", sql=with_views(
    ", t AS (SELECT CAST(count(*) FILTER (WHERE flag_disc = 1 AND outcome = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE flag_disc = 1 AND outcome = 0) AS DOUBLE) AS b, "
    "CAST(count(*) FILTER (WHERE flag_disc = 0 AND outcome = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE flag_disc = 0 AND outcome = 0) AS DOUBLE) AS d FROM f_flags WHERE flag_r = 1) "
    f"SELECT 'flag_disc' AS term, {r('ln(a * d / (b * c))')} AS coef, {r('sqrt(1 / a + 1 / b + 1 / c + 1 / d)')} AS se, 'estimated' AS status FROM t UNION ALL "
    "SELECT term, NULL, NULL, status FROM (VALUES ('Intercept', 'separated'), ('flag_r', 'separated'), ('twice', 'aliased')) v(term, status)",
    "f_flags").replace("\n, t AS", ", t AS"))
def logit_separated(spark, sf_dir):
    """No row without flag_r has the outcome: the flag and the intercept have no finite
    estimate, flag_disc is estimated on the rows that have the flag."""
    df = FX.f_flags(spark, sf_dir).withColumn("twice", 2 * F.col("flag_disc") + 1)
    table, _ = M.logit_fit(df, "outcome", ["flag_r", "flag_disc", "twice"])
    return rounded(table.select("term", "coef", "se", "status"))


@query("odds_ratio_of_a_flag", "R4 C12 J4", sql=with_views(
    f", t AS {_two_by_two()} SELECT term, round_even(coef, 4) AS coef, round_even(exp(coef), 4) AS odds_ratio, round_even(exp(coef - {M.Z975} * se), 4) AS ci_lo, "
    f"round_even(exp(coef + {M.Z975} * se), 4) AS ci_hi FROM (SELECT 'Intercept' AS term, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM t UNION ALL "
    "SELECT 'flag_disc', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM t) x", "f_flags").replace("\n, t AS", ", t AS"))
def odds_ratio_of_a_flag(spark, sf_dir):
    table, _ = M.logit_fit(FX.f_flags(spark, sf_dir), "outcome", ["flag_disc"])
    return M.logit_odds_ratios(table).drop("p", "p_fdr")


@query("logit_odds_ratios", "R4 C12 J4 T7")
def logit_odds_ratios(spark, sf_dir):
    table, _ = M.logit_fit(FX.f_cohort(spark, sf_dir), "outcome", ["avg_qty", "avg_disc", "C(r_name)"])
    return M.logit_odds_ratios(table)


NULL_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("impute_mean", "M1", sql=with_views(
    "SELECT " + ", ".join(f"{r(f'coalesce(CAST({c} AS DOUBLE), avg({c}) OVER ())')} AS {c}" for c in NULL_COLS)
    + " FROM f_nulls", "f_nulls"))
def impute_mean(spark, sf_dir):
    fn = FX.f_nulls(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in NULL_COLS])
    return rounded(M.impute_mean(fn, NULL_COLS))


# One gap column, one predictor, no penalty: the chained imputer is then a simple regression, as SQL has it.
_CHAINED_SQL = with_views(
    "SELECT " + r("l_quantity") + " AS l_quantity, " + r(
        "coalesce(CAST(l_tax AS DOUBLE), (SELECT regr_intercept(l_tax, l_quantity) FROM f_nulls) + "
        "(SELECT regr_slope(l_tax, l_quantity) FROM f_nulls) * l_quantity)") + " AS l_tax FROM f_nulls", "f_nulls")


@query("impute_chained_simple", "M1", sql=_CHAINED_SQL)
def impute_chained_simple(spark, sf_dir):
    fn = FX.f_nulls(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax")])
    return rounded(PL.fit_imputer(fn, ["l_quantity", "l_tax"], rounds=2, reg=0.0).transform(fn))


@query("impute_chained", "M1")
def impute_chained(spark, sf_dir):
    fn = FX.f_nulls(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in NULL_COLS])
    return PL.fit_imputer(fn, NULL_COLS, rounds=2).transform(fn)


SCALE_COLS = [f"e{i}" for i in range(8)]


@query("scale_features", "M2", sql=with_views(
    "SELECT vec_id, " + ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}"
                                  for c in SCALE_COLS) + " FROM f_wide", "f_wide"))
def scale_features(spark, sf_dir):
    w = FX.f_wide(spark, sf_dir)
    return rounded(M.scale_features(w, SCALE_COLS, ddof=0, keep=["vec_id"]))


def _kbest_sql() -> str:
    inner = _anova_sql()
    # _anova_sql already starts with the f_wide CTE: select from it as a subquery.
    head, body = inner.split("\nSELECT \"column\", ", 1)
    return head + "\nSELECT \"column\", F FROM (SELECT \"column\", " + body + ") a ORDER BY F DESC, \"column\" LIMIT 10"


def _kbest_sql_of_cohort() -> str:
    cols = ["o_totalprice", "c_acctbal", "n_lines", "avg_qty", "avg_disc"]
    some = "(SELECT * FROM f_cohort WHERE n_lines IS NOT NULL)"
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM "
        f"(SELECT outcome, count(*) AS n, avg({c}) AS m, var_samp({c}) AS v, (SELECT avg({c}) FROM {some} a) AS g FROM {some} b GROUP BY outcome) x"
        for c in cols)
    return f"SELECT feature, {r('f')} AS value FROM ({each}) y ORDER BY f DESC, feature LIMIT 3"


@query("select_k_best", "M4 W6 T9", sql=_kbest_sql())
def select_k_best(spark, sf_dir):
    f = ST.anova_f(FX.f_wide(spark, sf_dir), FX.embed_cols(), "y")
    return rounded(f.orderBy(F.desc("F"), "column").limit(10).select("column", "F"))


@query("class_weights", "M5", sql=with_views(
    "SELECT y, count(*) AS n_class, " + r("sum(count(*)) OVER () / (count(*) OVER () * count(*))")
    + " AS weight FROM f_wide GROUP BY y", "f_wide"))
def class_weights(spark, sf_dir):
    return rounded(M.class_weights(FX.f_wide(spark, sf_dir), "y"))


@query("select_elastic_net", "M3 P11")
def select_elastic_net(spark, sf_dir):
    return M.select_elastic_net(FX.f_wide(spark, sf_dir), FX.embed_cols(), "y", reg=0.05, l1_ratio=0.5)


@query("elastic_net_optimality", "M3", sql=" UNION ALL ".join(f"SELECT '{c}' AS feature, true AS optimal" for c in ["(intercept)", *FX.embed_cols()]))
def elastic_net_optimality(spark, sf_dir):
    """First-order conditions of the selector's objective, the gradient taken by column expressions."""
    alpha, l1_ratio, cols = 0.05, 0.5, FX.embed_cols()
    z = cut_lineage(M.scale_features(FX.f_wide(spark, sf_dir), cols, ddof=0, keep=["y"]))
    found = PL.fit_selector(z, cols, "y", "elastic_net", alpha, l1_ratio)
    margin = sum((F.lit(found.scores[c]) * F.col(c) for c in cols), F.lit(found.intercept))
    error = 1.0 / (1.0 + F.exp(-margin)) - F.col("y")
    slopes = z.agg(F.avg(error).alias("(intercept)"), *[F.avg(error * F.col(c)).alias(c) for c in cols])

    def holds(c):
        w = found.scores[c]
        if w:
            return F.abs(F.col(c) + alpha * (l1_ratio * (1 if w > 0 else -1) + (1 - l1_ratio) * w)) < 1e-6
        return F.abs(F.col(c)) < alpha * l1_ratio + 1e-6

    facts = [F.struct(F.lit(c).alias("feature"), (holds(c) if c in cols else F.abs(F.col(c)) < 1e-6).alias("optimal")) for c in ["(intercept)", *cols]]
    return slopes.select(F.explode(F.array(*facts)).alias("x")).select("x.*")


@query("svm_optimality", "M5", sql="SELECT 'duality gap' AS fact, true AS holds UNION ALL SELECT 'dual weights balance' AS fact, true AS holds")
def svm_optimality(spark, sf_dir):
    """The SVM's primal and dual objectives by column expressions: no weights could do better than the gap."""
    cols, cost, tol = FX.embed_cols(), 1.0, 1e-3
    w = cut_lineage(FX.f_wide(spark, sf_dir))
    svm = PL.fit_svm(w, cols, "y", cost, tol)
    n = {row["y"]: row["n"] for row in w.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    c = F.when(F.col("y") == 1, cost * sum(n.values()) / (2 * n[1])).otherwise(cost * sum(n.values()) / (2 * n[0]))
    side = 2 * F.col("y") - 1
    u = F.lit(1.0) - side * svm.margin()
    a = c * F.least(F.greatest(u / svm.width, F.lit(0.0)), F.lit(1.0))
    of = lambda k, x: F.sum(F.when(F.col("y") == k, x).otherwise(0.0))
    row = w.withColumns({"_a": a, "_c": c, "_u": u}).agg(F.sum(F.col("_c") * F.greatest("_u", F.lit(0.0))).alias("hinge"), of(1, F.col("_a")).alias("a1"), of(0, F.col("_a")).alias("a0"),
                                                         *[of(k, F.col("_a") * F.col(x)).alias(f"x{k}{x}") for k in (0, 1) for x in cols]).first()
    least = min(row["a1"], row["a0"])
    pull = sum((row["x1" + x] * least / row["a1"] - row["x0" + x] * least / row["a0"]) ** 2 for x in cols)
    primal = sum(b * b for b in svm.weights) / 2 + row["hinge"]
    facts = [("duality gap", primal - (2 * least - pull / 2) <= 1.001 * tol * primal), ("dual weights balance", abs(row["a1"] - row["a0"]) <= 0.05 * least)]
    return spark.createDataFrame(facts, "fact string, holds boolean")


_KEYS_ONCE = "SELECT count(*) AS n, count(DISTINCT {key}) AS n_keys, CAST(0 AS BIGINT) AS n_bad FROM {src}"


def _facts(df, key):
    """Rows, distinct keys and scores that are no probability of a fitted model's output."""
    bad = F.count(F.when(F.col("prob").isNull() | ~F.col("prob").between(0, 1), F.lit(1)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), bad.alias("n_bad"))


@query("svm_balanced", "M5")
def svm_balanced(spark, sf_dir):
    w = FX.f_wide(spark, sf_dir)
    svm = PL.calibrate(w, "vec_id", FX.embed_cols(), "y", cost=1.0)
    return w.select("vec_id", "y", svm.margin().alias("margin"), svm.probability().alias("prob"))


OUTER_K, INNER_K = 10, 3

# The order-level cohort carries real signal for its outcome and has NULLs
# (orders without lines), so every stage of the tuned pipeline does work.
COHORT_FEATURES = ["o_totalprice", "c_acctbal", "n_lines", "avg_qty", "avg_disc"]


def _cohort(spark, sf_dir):
    return cut_lineage(FX.f_cohort(spark, sf_dir).select("o_orderkey", "outcome", *COHORT_FEATURES))


@query("nested_cv", "M6 M8 M9 M13")
def nested_cv(spark, sf_dir):
    return PL.nested(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, outer_k=OUTER_K, inner_k=INNER_K).scores


@query("oof_probabilities", "M8b")
def oof_probabilities(spark, sf_dir):
    """Held-out probabilities of the tuned model, the search of ``nested_cv`` in every fold."""
    return PL.nested(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, outer_k=OUTER_K, inner_k=INNER_K).oof


@query("oof_every_key_once", "M8b M13", sql=with_views(_KEYS_ONCE.format(key="o_orderkey", src="f_cohort"), "f_cohort"))
def oof_every_key_once(spark, sf_dir):
    """Rows, distinct keys and invalid probabilities of a three-fold run."""
    found = PL.nested(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, PL.cells(costs=(1.0,)), outer_k=3)
    return _facts(found.oof, "o_orderkey")


GRID = PL.cells(costs=(0.1, 1.0), alphas=(0.001, 0.01))


@query("grid_search", "M7")
def grid_search(spark, sf_dir):
    return PL.search(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, GRID, INNER_K)[1]


@query("grid_search_best", "M7", sql=f"SELECT CAST({len(GRID)} AS BIGINT) AS n_cells, CAST({2 * INNER_K} AS INTEGER) AS n_scores, true AS best_is_greatest")
def grid_search_best(spark, sf_dir):
    """The cell returned has the table's greatest mean score over all repeated folds."""
    best, table = PL.search(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, GRID, INNER_K, repeats=2)
    chosen = (F.col("alpha") == best["alpha"]) & (F.col("l1_ratio") == best["l1_ratio"]) & (F.col("cost") == best["cost"])
    return table.agg(F.count(F.lit(1)).alias("n_cells"), F.min("n").alias("n_scores"),
                     (F.max(F.when(chosen, F.col("score"))) == F.max("score")).alias("best_is_greatest"))


@query("selected_features", "M10 F10 W5")
def selected_features(spark, sf_dir):
    coh = _cohort(spark, sf_dir)
    rows = PL.laid(coh, "o_orderkey", "outcome", COHORT_FEATURES, INNER_K)
    best, _ = PL.search(coh, "o_orderkey", "outcome", COHORT_FEATURES, PL.cells(), INNER_K, rows=rows)
    found = PL.selected(spark, PL.fit(coh, "o_orderkey", "outcome", COHORT_FEATURES, best, rows=rows))
    return R.drop_zero(found, "value").orderBy(F.desc("value"), "feature")


@query("best_parameters", "M7 M10")
def best_parameters(spark, sf_dir):
    """The best cell with its inner score, and the columns its refitted pipeline selects."""
    coh = _cohort(spark, sf_dir)
    rows = PL.laid(coh, "o_orderkey", "outcome", COHORT_FEATURES, INNER_K)
    best, table = PL.search(coh, "o_orderkey", "outcome", COHORT_FEATURES, GRID, INNER_K, rows=rows)
    found = PL.selected(spark, PL.fit(coh, "o_orderkey", "outcome", COHORT_FEATURES, best, rows=rows))
    row = table.where((F.col("alpha") == best["alpha"]) & (F.col("l1_ratio") == best["l1_ratio"]) & (F.col("cost") == best["cost"])).first()
    return found.select(*[F.lit(row[c]).alias(c) for c in ("alpha", "l1_ratio", "cost", "score", "sd", "n")], "feature", "value")


@query("selected_f_test", "M4 M6 M10", sql=with_views(
    _kbest_sql_of_cohort(), "f_cohort"))
def selected_f_test(spark, sf_dir):
    """The F selector inside the pipeline: the three greatest F of the imputed, scaled features."""
    coh = _cohort(spark, sf_dir).na.drop("any")
    model = PL.fit(coh, "o_orderkey", "outcome", COHORT_FEATURES, PL.cells()[0], PL.Settings(selector="f_test", k=3))
    return rounded(PL.selected(spark, model))


@query("permutation_refit", "M11 A19", sql="SELECT CAST(5 AS BIGINT) AS n_null, true AS p_fits")
def permutation_refit(spark, sf_dir):
    """The refitting permutation test with a small n: as many null scores as asked for, p = (k + 1) / (n + 1)."""
    out = CV.permutation_test_refit(_cohort(spark, sf_dir), "o_orderkey", "outcome", COHORT_FEATURES, true_score=0.9, n_permutations=5)
    return out.select("n_null", (F.abs(F.col("p_value") - (F.col("n_exceed") + 1) / (F.col("n_null") + 1)) < 1e-12).alias("p_fits"))


@query("model_roundtrip", "S7")
def model_roundtrip(spark, sf_dir):
    w = FX.f_wide(spark, sf_dir)
    live = PL.fit(w, "vec_id", "y", FX.embed_cols(), PL.cells()[0])
    return PL.Fitted.load(spark, live.save(spark, scratch_path(spark, "model"))).transform(w, ["vec_id", "y"]).drop("margin")


@query("model_roundtrip_equal", "S7", sql=with_views(
    "SELECT count(*) AS n, count(*) AS n_equal FROM f_cohort", "f_cohort"))
def model_roundtrip_equal(spark, sf_dir):
    """A saved and loaded pipeline gives every row the live one's probability."""
    coh = _cohort(spark, sf_dir)
    live = PL.fit(coh, "o_orderkey", "outcome", COHORT_FEATURES, PL.cells()[0])
    loaded = PL.Fitted.load(spark, live.save(spark, scratch_path(spark, "model")))
    both = live.transform(coh, ["o_orderkey"]).join(loaded.transform(coh, ["o_orderkey"]).select("o_orderkey", F.col("prob").alias("again")), "o_orderkey")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("prob") == F.col("again"), F.lit(1))).alias("n_equal"))
