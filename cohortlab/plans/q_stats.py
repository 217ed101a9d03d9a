"""Registered queries: profiling, describing, ranks and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..operators import describe as A
from ..operators import profile as PR
from ..operators import ranks as W
from ..operators import stattests as ST
from . import fixtures as FX
from .fixtures import with_views
from .registry import query
from .sqlgen import describe_sql, midrank_sql, r, rounded, union

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COHORT_CONT = ["o_totalprice", "c_acctbal", "n_lines", "avg_qty", "avg_disc"]
PROFILE_COLS = ["one", "flag", "n_regionkey", "s_acctbal", "l_linenumber", "l_linecode",
                "l_quantity", "l_discount", "l_tax"]
LI_CORR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


# --------------------------------------------------------------- describe
@query("describe", "A1", sql=describe_sql("lineitem", LI_NUM))
def describe(spark, sf_dir):
    return A.describe(FX.t(spark, sf_dir, "lineitem"), LI_NUM)


@query("describe_by_group", "A2", sql=with_views(describe_sql("f_cohort", COHORT_CONT, ["outcome"]),
                                                 "f_cohort"))
def describe_by_group(spark, sf_dir):
    return A.describe(FX.staged(FX.f_cohort(spark, sf_dir)), COHORT_CONT, by=["outcome"])


_ORDERS_WITH_NULL = "(SELECT NULLIF(o_orderstatus, 'P') AS status, o_totalprice, o_custkey FROM orders)"


@query("describe_null_group", "A2", sql=describe_sql(_ORDERS_WITH_NULL, ["o_totalprice", "o_custkey"], ["status"]))
def describe_null_group(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders")
    o = o.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", "o_custkey")
    return A.describe(FX.staged(o), ["o_totalprice", "o_custkey"], by=["status"])


@query("stratum_mean_std", "A3", sql=with_views(
    "SELECT outcome, c_mktsegment, count(o_totalprice) AS n, round_even(avg(o_totalprice), 2) AS mean, "
    "round_even(stddev_samp(o_totalprice), 2) AS std FROM f_cohort GROUP BY outcome, c_mktsegment",
    "f_cohort"))
def stratum_mean_std(spark, sf_dir):
    return A.stratum_mean_std(FX.f_cohort(spark, sf_dir), "o_totalprice", ["outcome", "c_mktsegment"])


@query("count_by_strata", "A4", sql=with_views(
    "SELECT outcome, flag_disc, count(*) AS n FROM f_flags GROUP BY outcome, flag_disc", "f_flags"))
def count_by_strata(spark, sf_dir):
    return A.count_by_strata(FX.f_flags(spark, sf_dir), ["outcome", "flag_disc"])


@query("value_counts", "A5", sql=(
    "SELECT o_orderpriority, count(*) AS count, "
    + r("count(*) / sum(count(*)) OVER ()") + " AS share FROM orders GROUP BY o_orderpriority"))
def value_counts(spark, sf_dir):
    return rounded(A.value_counts(FX.t(spark, sf_dir, "orders"), "o_orderpriority"))


@query("flag_counts_by_outcome", "A10", sql=with_views(union([
    f"SELECT '{f}' AS flag, CAST(sum(CASE WHEN outcome = 0 THEN {f} ELSE 0 END) AS BIGINT) AS n_outcome_0, "
    f"CAST(sum(CASE WHEN outcome = 1 THEN {f} ELSE 0 END) AS BIGINT) AS n_outcome_1 FROM f_flags"
    for f in FX.FLAG_NAMES]), "f_flags"))
def flag_counts_by_outcome(spark, sf_dir):
    return A.flag_counts_by_outcome(FX.f_flags(spark, sf_dir), FX.FLAG_NAMES, "outcome")


@query("crosstab", "A11", sql=(
    "SELECT s.o_orderstatus, p.o_orderpriority, CAST(count(o.o_orderkey) AS BIGINT) AS n "
    "FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN "
    "(SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o "
    "ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority "
    "GROUP BY s.o_orderstatus, p.o_orderpriority"))
def crosstab(spark, sf_dir):
    return A.crosstab(FX.t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("target_correlations", "A14 W5", sql=union([
    f"SELECT '{c}' AS \"column\", {r(f'corr({c}, l_extendedprice)')} AS r FROM lineitem" for c in LI_CORR]))
def target_correlations(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return rounded(A.target_correlations(li, "l_extendedprice", LI_CORR))


STD_COLS = ["o_totalprice", "c_acctbal", "avg_qty"]


@query("standardize", "A15", sql=with_views(
    "SELECT o_orderkey, " + ", ".join(
        f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in STD_COLS)
    + " FROM f_cohort", "f_cohort"))
def standardize(spark, sf_dir):
    coh = FX.staged(FX.f_cohort(spark, sf_dir).select("o_orderkey", *STD_COLS))
    return rounded(A.standardize(coh, STD_COLS))


# ---------------------------------------------------------------- profile
EV_COLS = ["value", "user_id", "event_id"]


@query("iqr_outliers", "A6 F9", sql=union([
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) "
    f"OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers FROM events, "
    f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)"
    for c in EV_COLS]))
def iqr_outliers(spark, sf_dir):
    return PR.iqr_outliers(FX.t(spark, sf_dir, "events"), EV_COLS)


@query("na_percent", "A7", sql=with_views(union([
    f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100')} "
    f"AS percent_missing FROM f_nulls" for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]]),
    "f_nulls"))
def na_percent(spark, sf_dir):
    return rounded(PR.na_percent(FX.f_nulls(spark, sf_dir)))


@query("column_max", "A8 W5", sql=with_views(union([
    f"SELECT '{c}' AS \"column\", CAST(max({c}) AS DOUBLE) AS max FROM f_profile" for c in PROFILE_COLS]),
    "f_profile"))
def column_max(spark, sf_dir):
    return PR.column_max(FX.f_profile(spark, sf_dir))


@query("column_nunique", "A9", sql=with_views(union([
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS nunique FROM f_profile"
    for c in PROFILE_COLS]), "f_profile"))
def column_nunique(spark, sf_dir):
    return PR.column_nunique(FX.f_profile(spark, sf_dir))


@query("drop_constant", "P7", sql=with_views(
    "SELECT " + ", ".join(c for c in PROFILE_COLS if c != "one") + " FROM f_profile", "f_profile"))
def drop_constant(spark, sf_dir):
    return PR.drop_constant(FX.f_profile(spark, sf_dir))


@query("drop_sparse", "P8", sql=with_views(
    "SELECT " + ", ".join(c for c in PROFILE_COLS if c != "l_linecode") + " FROM f_profile", "f_profile"))
def drop_sparse(spark, sf_dir):
    return PR.drop_sparse(FX.f_profile(spark, sf_dir))


def _infer_sql() -> str:
    parts = []
    for c in PROFILE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", max({x}) AS max, "
            f"count(*) FILTER (WHERE {x} NOT IN (0.0, 1.0)) AS nonbin, "
            f"count(DISTINCT {x}) AS nd FROM f_profile")
    return with_views(
        "SELECT \"column\", max, CASE WHEN NOT (nonbin = 0 AND max = 1.0) AND max <= 7 "
        "THEN CAST(nd AS BIGINT) END AS n_distinct, "
        "CASE WHEN nonbin = 0 AND max = 1.0 THEN 'boolean' "
        "WHEN max <= 7 AND nd < 7 THEN 'category' ELSE 'double' END AS inferred FROM ("
        + union(parts) + ")", "f_profile")


@query("infer_types", "Y1 Y2 Y3 Y4", sql=_infer_sql())
def infer_types(spark, sf_dir):
    return PR.infer_types(FX.f_profile(spark, sf_dir))


# ------------------------------------------------------------------ ranks
# What the rules of Y1-Y3 make of the columns, whose domains are the same at every scale.
PROFILE_TYPES = {"one": "boolean", "flag": "boolean", "n_regionkey": "category", "s_acctbal": "double", "l_linenumber": "double",
                 "l_linecode": "category", "l_quantity": "double", "l_discount": "double", "l_tax": "double"}


def _typed_sql() -> str:
    made = {"boolean": "{0} <> 0", "category": "CAST({0} AS INTEGER)", "double": "CAST({0} AS DOUBLE)"}
    return with_views("SELECT " + ", ".join(f"{made[k].format(c)} AS {c}" for c, k in PROFILE_TYPES.items()) + " FROM f_profile", "f_profile")


@query("typed_frame", "Y1 Y2 Y3 Y4", sql=_typed_sql())
def typed_frame(spark, sf_dir):
    df = FX.f_profile(spark, sf_dir)
    found = PR.infer_types(df, exact_counts=False).collect()  # one row a column
    return PR.apply_types(df, {r["column"]: r["inferred"] for r in found})


@query("midrank", "W1", sql=(
    "SELECT l_linestatus, l_extendedprice, count(*) AS n, "
    "sum(count(*)) OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) - (count(*) - 1) / 2.0 "
    "AS midrank FROM lineitem GROUP BY l_linestatus, l_extendedprice"))
def midrank(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    m = W.midranks(li, ["l_linestatus"], "l_extendedprice")
    return m.select("l_linestatus", "l_extendedprice", "n", "midrank")


def _chi2_flags_sql() -> str:
    """Chi-square of each F-flags column against outcome, in SQL."""
    parts = []
    for f in FX.FLAG_NAMES:
        parts.append(
            f"SELECT '{f}' AS flag, sum(o * o / e) - max(nn) AS chi2, "
            f"(count(DISTINCT lvl) - 1) * (count(DISTINCT outcome) - 1) AS dof, max(nn) AS n FROM ("
            f"SELECT lvl, outcome, o, sum(o) OVER (PARTITION BY lvl) * sum(o) OVER (PARTITION BY outcome) "
            f"/ sum(o) OVER () AS e, sum(o) OVER () AS nn FROM ("
            f"SELECT {f} AS lvl, outcome, CAST(count(*) AS DOUBLE) AS o FROM f_flags GROUP BY {f}, outcome)"
            f" c) e")
    return union(parts)


def _bh_sql(src: str, p: str = "p") -> str:
    return (f"SELECT *, least(min({p} * m / rk) OVER (ORDER BY {p}, flag ROWS BETWEEN CURRENT ROW AND "
            f"UNBOUNDED FOLLOWING), 1.0) AS p_fdr FROM (SELECT *, row_number() OVER (ORDER BY {p}, flag) "
            f"AS rk, count(*) OVER () AS m FROM {src}) b")


@query("fdr_bh", "W2 T7", sql=with_views(
    "SELECT flag, " + r("p") + " AS p, " + r("p_fdr") + " AS p_fdr, p_fdr <= 0.05 AS reject FROM ("
    + _bh_sql(f"(SELECT flag, {D.sql_chi2_sf('chi2', 'dof')} AS p FROM ({_chi2_flags_sql()}) x) y")
    + ") z", "f_flags"))
def fdr_bh(spark, sf_dir):
    tests = ST.chi2_independence(FX.f_flags(spark, sf_dir), FX.FLAG_NAMES, "outcome") \
        .withColumnRenamed("column", "flag").select("flag", "p")
    return rounded(W.fdr_bh(tests, "p", order_tie=["flag"]).select("flag", "p", "p_fdr", "reject"))


# ------------------------------------------------------------------ tests
def _kruskal_sql() -> str:
    ranks = midrank_sql("lineitem", "l_quantity", [], ["l_returnflag"])
    return (
        "SELECT " + r("H") + " AS H, CAST(k - 1 AS BIGINT) AS df, CAST(N AS BIGINT) AS n, "
        + r(D.sql_chi2_sf("H", "(k - 1)")) + " AS p FROM ("
        "SELECT (12.0 / (N * (N + 1)) * S - 3 * (N + 1)) / (1 - T / (N * N * N - N)) AS H, k, N FROM ("
        "SELECT sum(n) AS N, sum(R * R / n) AS S, count(*) AS k, "
        "(SELECT sum(t * t * t - t) FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM lineitem "
        "GROUP BY l_quantity)) AS T FROM ("
        f"SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, sum(_mid) AS R FROM {ranks} x "
        "GROUP BY l_returnflag) g) s) h")


@query("kruskal", "T1 W1", sql=_kruskal_sql())
def kruskal(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return rounded(ST.kruskal(li, "l_quantity", "l_returnflag"))


def _mw_sql() -> str:
    ranks = midrank_sql("lineitem", "l_extendedprice", ["l_returnflag"], ["l_linestatus"])
    ties = ("(SELECT l_returnflag, sum(t * t * t - t) AS T FROM (SELECT l_returnflag, "
            "CAST(count(*) AS DOUBLE) AS t FROM lineitem GROUP BY l_returnflag, l_extendedprice) "
            "GROUP BY l_returnflag)")
    g = ("SELECT x.l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN _mid END) AS Rx, "
         "CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS nx, "
         "CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS DOUBLE) AS ny "
         f"FROM {ranks} x GROUP BY x.l_returnflag")
    u = ("SELECT g.l_returnflag, Rx - nx * (nx + 1) / 2 AS ux, nx * ny - (Rx - nx * (nx + 1) / 2) AS uy, "
         "sqrt((1 - t.T / ((nx + ny) * (nx + ny) * (nx + ny) - (nx + ny))) * nx * ny * (nx + ny + 1) / 12) "
         f"AS sd, nx * ny / 2 AS mu, nx, ny FROM ({g}) g JOIN {ties} t ON g.l_returnflag = t.l_returnflag")
    z = "(greatest(ux, uy) - mu - 0.5) / sd"
    return (f"SELECT l_returnflag, {r('least(ux, uy)')} AS U, {r(z)} AS z, "
            f"{r(D.sql_norm_sf(f'abs({z})'))} AS p, CAST(nx AS BIGINT) AS n_x, CAST(ny AS BIGINT) AS n_y "
            f"FROM ({u}) u")


@query("mann_whitney", "T2 W1", sql=_mw_sql())
def mann_whitney(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return rounded(ST.mann_whitney(li, "l_extendedprice", "l_linestatus", "F", part=["l_returnflag"]).drop("n_groups"))


def _ttest_sql(equal_var: bool) -> str:
    parts = []
    for c in COHORT_CONT:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({c}) FILTER (WHERE outcome = 1) AS DOUBLE) AS na, "
            f"avg({c}) FILTER (WHERE outcome = 1) AS ma, var_samp({c}) FILTER (WHERE outcome = 1) AS va, "
            f"CAST(count({c}) FILTER (WHERE outcome = 0) AS DOUBLE) AS nb, "
            f"avg({c}) FILTER (WHERE outcome = 0) AS mb, var_samp({c}) FILTER (WHERE outcome = 0) AS vb "
            f"FROM f_cohort")
    m = union(parts)
    if equal_var:
        t = ("(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))")
        dof = "(na + nb - 2)"
    else:
        t = "(ma - mb) / sqrt(va / na + vb / nb)"
        dof = ("((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) "
               "+ (vb / nb) * (vb / nb) / (nb - 1)))")
    return with_views(
        f"SELECT \"column\", {r('t')} AS t, {r('df')} AS df, {r(D.sql_t_sf_two_sided('t', 'df'))} AS p "
        f"FROM (SELECT \"column\", {t} AS t, {dof} AS df FROM ({m}) m) x", "f_cohort")


@query("ttest_pooled", "T3", sql=_ttest_sql(True))
def ttest_pooled(spark, sf_dir):
    return rounded(ST.ttest(FX.f_cohort(spark, sf_dir), COHORT_CONT, "outcome", 1, 0, equal_var=True))


@query("ttest_welch", "T4", sql=_ttest_sql(False))
def ttest_welch(spark, sf_dir):
    return rounded(ST.ttest(FX.f_cohort(spark, sf_dir), COHORT_CONT, "outcome", 1, 0, equal_var=False))


def _oneway_sql(groups_sql: str) -> str:
    """``groups_sql`` yields (column, n, mean, var) per group."""
    f = ("((s2 - s1 * s1 / N) / (k - 1)) / (within / (N - k))")
    agg = (f"SELECT \"column\", sum(n) AS N, CAST(count(*) AS DOUBLE) AS k, sum(n * mean) AS s1, "
           f"sum(n * mean * mean) AS s2, sum((n - 1) * coalesce(var, 0)) AS within FROM ({groups_sql}) g "
           f"GROUP BY \"column\"")
    return (f"SELECT \"column\", {r('F')} AS F, df_between, df_within, "
            f"{r(D.sql_f_sf('F', 'df_between', 'df_within'))} AS p FROM ("
            f"SELECT \"column\", {f} AS F, k - 1 AS df_between, N - k AS df_within FROM ({agg}) a) x")


LEVENE_COLS = ["o_totalprice", "c_acctbal", "avg_qty"]


def _levene_sql() -> str:
    parts = []
    for c in LEVENE_COLS:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count(*) AS DOUBLE) AS n, avg(z) AS mean, var_samp(z) AS var "
            f"FROM (SELECT f.outcome, abs(f.{c} - m.med) AS z FROM f_cohort f JOIN "
            f"(SELECT outcome, quantile_cont({c}, 0.5) AS med FROM f_cohort WHERE {c} IS NOT NULL "
            f"GROUP BY outcome) m ON f.outcome = m.outcome WHERE f.{c} IS NOT NULL) d GROUP BY outcome")
    return with_views(_oneway_sql(union(parts)), "f_cohort")


@query("levene_median", "T5", sql=_levene_sql())
def levene_median(spark, sf_dir):
    return rounded(ST.levene_median(FX.staged(FX.f_cohort(spark, sf_dir)), LEVENE_COLS, "outcome"))


@query("chi2_independence", "T6 A11", sql=with_views(
    f"SELECT flag AS \"column\", {r('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, "
    f"{r(D.sql_chi2_sf('chi2', 'dof'))} AS p FROM ({_chi2_flags_sql()}) x", "f_flags"))
def chi2_independence(spark, sf_dir):
    return rounded(ST.chi2_independence(FX.f_flags(spark, sf_dir), FX.FLAG_NAMES, "outcome"))


@query("chi2_expected", "T6 A11", sql=(
    "SELECT l.o_orderpriority AS level, o.o_orderstatus, count(x.o_orderkey) AS observed, " + r("max(l.n) * max(o.n) / max(t.n)") + " AS expected FROM "
    "(SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_orderpriority) l CROSS JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) o "
    "CROSS JOIN (SELECT count(*) AS n FROM orders) t LEFT JOIN orders x ON x.o_orderpriority = l.o_orderpriority AND x.o_orderstatus = o.o_orderstatus GROUP BY l.o_orderpriority, o.o_orderstatus"))
def chi2_expected(spark, sf_dir):
    return rounded(ST.chi2_expected(FX.t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"))


def _flag_summary_sql() -> str:
    counts = union([
        f"SELECT '{f}' AS flag, CAST(sum(CASE WHEN outcome = 0 THEN {f} ELSE 0 END) AS BIGINT) AS n_outcome_0, "
        f"CAST(sum(CASE WHEN outcome = 1 THEN {f} ELSE 0 END) AS BIGINT) AS n_outcome_1 FROM f_flags"
        for f in FX.FLAG_NAMES])
    tests = f"(SELECT flag, chi2, dof, {D.sql_chi2_sf('chi2', 'dof')} AS p FROM ({_chi2_flags_sql()}) x)"
    return with_views(
        "SELECT c.flag, c.n_outcome_0, c.n_outcome_1, round(t.chi2, 4) AS chi2, CAST(t.dof AS BIGINT) AS dof, "
        "round_even(t.p, 3) AS p, round_even(t.p_fdr, 3) AS p_fdr "
        f"FROM ({counts}) c JOIN ({_bh_sql(tests)}) t ON c.flag = t.flag", "f_flags")


@query("flag_summary_with_p", "T8 T6 T7 A10 C8 C9", sql=_flag_summary_sql())
def flag_summary_with_p(spark, sf_dir):
    return ST.flag_summary_with_p(FX.f_flags(spark, sf_dir), FX.FLAG_NAMES, "outcome")


def _anova_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS mean, "
             f"var_samp({c}) AS var FROM f_wide GROUP BY y" for c in FX.embed_cols()]
    return with_views(_oneway_sql(union(parts)), "f_wide")


@query("anova_f", "T9", sql=_anova_sql())
def anova_f(spark, sf_dir):
    w = FX.f_wide(spark, sf_dir)
    return rounded(ST.anova_f(w, FX.embed_cols(), "y"))
