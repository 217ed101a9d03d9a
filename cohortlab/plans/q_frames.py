"""Registered queries: sources, projections, filters, joins, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import columns as P
from ..operators import joins as J
from ..operators import rows as R
from ..session import scratch_path
from ..sources import io
from . import fixtures as FX
from .fixtures import with_views
from .registry import query

NATION_SCHEMA = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()),
    T.StructField("n_name", T.StringType()),
    T.StructField("n_regionkey", T.IntegerType()),
])

# Fixed parameters of the registered queries.
EXCLUDED_ORDER_KEYS = [0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]
RECODE_LINENUMBER = {1: 1, 3: 0}
PRIORITY_LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium"}
LINEITEM_RULES = {"l_quantity": [1.0, 50.0], "l_tax": [0.08], "l_discount": [0.03]}


@query("scan_csv_roundtrip", "S1 S8", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "nation-csv")
    io.write_csv(FX.t(spark, sf_dir, "nation"), path)
    return io.read_csv(spark, path, NATION_SCHEMA)


@query("codebook_join", "S2 J3 C14", sql=with_views(
    "SELECT p.p_partkey, p.p_type, coalesce(l.label, 'fehlt') AS label "
    "FROM part p LEFT JOIN lookup l ON p.p_type = l.p_type", "lookup"))
def codebook_join(spark, sf_dir):
    # The codebook arrives as a file (CSV instead of a spreadsheet sheet).
    path = scratch_path(spark, "codebook")
    io.write_csv(FX.lookup(spark).coalesce(1), path)
    cb = io.read_csv(spark, path, "p_type string, label string")
    part = FX.t(spark, sf_dir, "part").select("p_partkey", "p_type")
    return J.lookup_join(part, cb, "p_type", "label")


COHORT_NUM = ["o_orderkey", "outcome", "o_totalprice", "c_acctbal", "n_lines", "avg_qty"]


@query("sink_roundtrip", "S4 S5 S6", sql=with_views(
    "SELECT " + ", ".join(COHORT_NUM) + ", c_mktsegment FROM f_cohort", "f_cohort"))
def sink_roundtrip(spark, sf_dir):
    coh = FX.f_cohort(spark, sf_dir)
    base = scratch_path(spark, "modalities")
    paths = io.write_modalities(coh, base, {"numeric": COHORT_NUM[2:], "segment": ["c_mktsegment"]},
                                keep=["o_orderkey", "outcome"])
    csv_path = io.write_csv(io.load(spark, paths["segment"], "parquet"), base + "-segment-csv")
    num = io.load(spark, paths["numeric"], "parquet")
    seg = io.load(spark, csv_path, "csv", "o_orderkey bigint, outcome int, c_mktsegment string")
    return num.join(seg.drop("outcome"), "o_orderkey")


@query("select_list", "P1 S3", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_list(spark, sf_dir):
    return P.select_list(FX.t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("select_range", "P2", sql="SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_range(spark, sf_dir):
    return P.select_range(FX.t(spark, sf_dir, "lineitem"), "l_quantity", "l_tax")


@query("rename_map", "P3", sql=(
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, "
    "o_totalprice AS total_price, o_orderdate, o_orderpriority FROM orders"))
def rename_map(spark, sf_dir):
    return P.rename_map(FX.t(spark, sf_dir, "orders"),
                        {"o_orderkey": "order_id", "o_custkey": "customer_id",
                         "o_totalprice": "total_price"})


@query("strip_prefix", "P4", sql=(
    "SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, "
    "l_linenumber AS linenumber, l_quantity AS quantity, l_extendedprice AS extendedprice, "
    "l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag, "
    "l_linestatus AS linestatus, l_shipdate AS shipdate FROM lineitem"))
def strip_prefix(spark, sf_dir):
    return P.strip_prefix(FX.t(spark, sf_dir, "lineitem"), "l_")


@query("drop_cols", "P5", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_cols(spark, sf_dir):
    return P.drop_cols(FX.t(spark, sf_dir, "orders"), ["o_orderdate", "o_orderpriority"])


@query("drop_strings", "P6", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def drop_strings(spark, sf_dir):
    return P.drop_strings(FX.t(spark, sf_dir, "orders"))


@query("flag_index", "P9 J5", sql=with_views(
    "SELECT o_orderkey, outcome, "
    + " + ".join(FX.FLAG_NAMES) + " AS flag_index FROM f_flags", "f_flags"))
def flag_index(spark, sf_dir):
    fl = FX.f_flags(spark, sf_dir)
    return P.flag_index(fl, FX.FLAG_NAMES).select("o_orderkey", "outcome", "flag_index")


@query("cast_all", "P10", sql=with_views(
    "SELECT o_orderkey, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ["outcome"] + FX.FLAG_NAMES)
    + " FROM f_flags", "f_flags"))
def cast_all(spark, sf_dir):
    fl = FX.f_flags(spark, sf_dir)
    return P.cast_all(fl, "double", cols=["outcome"] + FX.FLAG_NAMES)


@query("modality_split", "P12", sql=with_views(
    "SELECT vec_id, y, " + ", ".join(f"e{i}" for i in range(8, 16)) + " FROM f_wide", "f_wide"))
def modality_split(spark, sf_dir):
    w = FX.f_wide(spark, sf_dir)
    groups = {f"mod{k}": [f"e{i}" for i in range(8 * k, 8 * k + 8)] for k in range(8)}
    return P.modality_split(w, groups, outcome="y", key="vec_id")["mod1"]


@query("modality_frames", "P12", sql=with_views(" UNION ALL ".join(
    [f"SELECT 'mod{k}' AS modality, vec_id, y, " + ", ".join(f"e{8 * k + i} AS v{i}" for i in range(8)) + " FROM f_wide" for k in range(8)]
    + ["SELECT 'rest' AS modality, vec_id, y, " + ", ".join(f"NULL AS v{i}" for i in range(8)) + " FROM f_wide"]), "f_wide"))
def modality_frames(spark, sf_dir):
    """All frames of the split, one below the other."""
    groups = {f"mod{k}": [f"e{i}" for i in range(8 * k, 8 * k + 8)] for k in range(8)}
    frames = P.modality_split(FX.f_wide(spark, sf_dir), groups, outcome="y", key="vec_id")
    rows = []
    for name, frame in frames.items():
        values = groups.get(name, [])
        rows.append(frame.select(F.lit(name).alias("modality"), "vec_id", "y", *[
            (F.col(values[i]) if values else F.lit(None).cast("double")).alias(f"v{i}") for i in range(8)]))
    return FX.union_all(rows)


@query("key_parse", "C1 P13", sql=(
    "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS parsed_key, "
    "TRY_CAST(substr(c_name, 10) AS BIGINT) + 10000 AS shifted_key FROM customer"))
def key_parse(spark, sf_dir):
    c = FX.t(spark, sf_dir, "customer")
    out = c.select("c_custkey", S.parse_key("c_name", 9).alias("parsed_key"))
    return P.shift_key(out.withColumn("shifted_key", F.col("parsed_key")), "shifted_key", 10000)


@query("filter_eq", "F1", sql="SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return R.filter_eq(FX.t(spark, sf_dir, "orders"), "o_orderstatus", "F")


@query("filter_and", "F2", sql=(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
    "WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 30"))
def filter_and(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return R.filter_and(li, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F",
                        F.col("l_quantity") >= 30) \
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("filter_threshold", "F3", sql=(
    "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 20"))
def filter_threshold(spark, sf_dir):
    ev = FX.t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.filter_threshold(ev, "value", 20)


@query("filter_notnull", "F4", sql=with_views(
    "SELECT * FROM f_nulls WHERE l_tax IS NOT NULL", "f_nulls"))
def filter_notnull(spark, sf_dir):
    return R.filter_notnull(FX.f_nulls(spark, sf_dir), "l_tax")


@query("complete_cases", "F5", sql=with_views(
    "SELECT * FROM f_nulls WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL "
    "AND l_tax IS NOT NULL AND l_linenumber IS NOT NULL", "f_nulls"))
def complete_cases(spark, sf_dir):
    return R.complete_cases(FX.f_nulls(spark, sf_dir))


@query("exclude_keys", "F6", sql=(
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN ("
    + ", ".join(map(str, EXCLUDED_ORDER_KEYS)) + ")"))
def exclude_keys(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.exclude_keys(o, "o_orderkey", EXCLUDED_ORDER_KEYS)


@query("first_n", "F7", sql=(
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1004"))
def first_n(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.first_n(o, 1004, ["o_orderkey"])


@query("mask_semi_join", "F8", sql=(
    "SELECT o.* FROM orders o WHERE o.o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') "
    "AND o.o_orderpriority = '1-URGENT'"))
def mask_semi_join(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders")
    c = FX.t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return R.mask_semi_join(o, c, "o_custkey", F.col("c_mktsegment") == "BUILDING",
                            F.col("o_orderpriority") == "1-URGENT")


@query("join_inner", "J1", sql=(
    "SELECT o.o_orderkey, c.c_custkey, c.c_name, c.c_mktsegment, o.o_totalprice "
    "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"))
def join_inner(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"),
                                            "o_orderkey", "o_totalprice")
    c = FX.t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return J.join_inner(o, c, "c_custkey").select("o_orderkey", "c_custkey", "c_name",
                                                   "c_mktsegment", "o_totalprice")


def _join_fold_sql() -> str:
    names = FX.modal_names()
    parts = [f"(SELECT TRY_CAST(substr(IID, 9) AS BIGINT) AS id, SCORE AS {n} FROM {FX.f_modal_sql(i)})"
             f" p{i}" for i, n in enumerate(names)]
    sql = "SELECT p0.id + 10000 AS id, " + ", ".join(f"p{i}.{n}" for i, n in enumerate(names))
    sql += " FROM " + parts[0]
    for i in range(1, len(parts)):
        sql += f" JOIN {parts[i]} ON p0.id = p{i}.id"
    return with_views(sql, "f_wide")


@query("join_fold", "J2 C1 P13", sql=_join_fold_sql())
def join_fold(spark, sf_dir):
    return J.parse_and_fold(FX.f_modal(spark, sf_dir), "IID", "SCORE", offset=8,
                            key="id", shift=10000)


@query("regex_clean", "C2", sql=(
    r"SELECT page_id, regexp_replace(url, '\W+', ' ', 'g') AS url_clean FROM pages"))
def regex_clean(spark, sf_dir):
    p = FX.t(spark, sf_dir, "pages")
    return p.select("page_id", S.regex_clean("url").alias("url_clean"))


@query("value_strip_prefix", "C3", sql=(
    "SELECT c_custkey, replace(c_name, 'Customer#', '') AS name_stripped FROM customer"))
def value_strip_prefix(spark, sf_dir):
    c = FX.t(spark, sf_dir, "customer")
    return c.select("c_custkey", S.value_strip_prefix("c_name", "Customer#").alias("name_stripped"))


@query("sentinel_to_null", "C4", sql=(
    "SELECT CASE WHEN l_orderkey IN (0, 1) THEN NULL ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN l_linenumber IN (0, 1) THEN NULL ELSE l_linenumber END AS l_linenumber, "
    "CASE WHEN l_quantity IN (0, 1) THEN NULL ELSE l_quantity END AS l_quantity, "
    "CASE WHEN l_discount IN (0, 1) THEN NULL ELSE l_discount END AS l_discount, "
    "CASE WHEN l_tax IN (0, 1) THEN NULL ELSE l_tax END AS l_tax, l_returnflag FROM lineitem"))
def sentinel_to_null(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_discount", "l_tax", "l_returnflag")
    return S.sentinel_to_null(li, codes=(0, 1))


@query("column_rules_to_null", "C5", sql=(
    "SELECT l_orderkey, CASE WHEN l_quantity IN (1.0, 50.0) THEN NULL ELSE l_quantity END AS l_quantity, "
    "CASE WHEN l_discount IN (0.03) THEN NULL ELSE l_discount END AS l_discount, "
    "CASE WHEN l_tax IN (0.08) THEN NULL ELSE l_tax END AS l_tax FROM lineitem"))
def column_rules_to_null(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return S.column_rules_to_null(li, LINEITEM_RULES)


@query("recode_map", "C6", sql=(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 3 THEN 0 "
    "ELSE l_linenumber END AS linenumber_recoded FROM lineitem"))
def recode_map(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.recode_map("l_linenumber", RECODE_LINENUMBER).alias("linenumber_recoded"))


@query("recode_labels", "C7", sql=(
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Urgent' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' "
    "ELSE o_orderpriority END AS priority_label FROM orders"))
def recode_labels(spark, sf_dir):
    o = FX.t(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.recode_map("o_orderpriority", PRIORITY_LABELS).alias("priority_label"))


@query("outcome_flag", "C8", sql=(
    "SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'F' AND li.n_returned >= 1 THEN 1 ELSE 0 END "
    "AS outcome FROM orders o LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' "
    "THEN 1 ELSE 0 END) AS n_returned FROM lineitem GROUP BY l_orderkey) li "
    "ON li.l_orderkey = o.o_orderkey"))
def outcome_flag(spark, sf_dir):
    li = (FX.t(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_returned")))
    o = FX.t(spark, sf_dir, "orders")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return j.select("o_orderkey", S.outcome_flag("o_orderstatus", "n_returned", "F", 1).alias("outcome"))


@query("any_flag", "C9 C10", sql=with_views(
    "SELECT o_orderkey, CASE WHEN flag_disc >= 1 OR flag_qty >= 1 THEN 1 ELSE 0 END AS any_dq, "
    "CASE WHEN " + " + ".join(FX.FLAG_NAMES) + " >= 5 THEN 1 ELSE 0 END AS load_ge5 FROM f_flags",
    "f_flags"))
def any_flag(spark, sf_dir):
    fl = P.flag_index(FX.f_flags(spark, sf_dir), FX.FLAG_NAMES)
    return fl.select("o_orderkey", S.any_flag(["flag_disc", "flag_qty"]).alias("any_dq"),
                     S.threshold_flag("flag_index", 5).alias("load_ge5"))


@query("round_half_even", "C11", sql=(
    "SELECT l_orderkey, l_quantity, round_even(l_quantity / 4, 1) AS q4_even FROM lineitem"))
def round_half_even(spark, sf_dir):
    li = FX.t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_quantity",
                     S.round_half_even(F.col("l_quantity") / 4, 1).alias("q4_even"))
