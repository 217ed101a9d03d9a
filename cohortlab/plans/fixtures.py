"""Fixture views derived from the driver tables (see FIXTURES.md section C).

Each view has a Spark builder and an SQL text with the same definition, so
the DuckDB oracle can rebuild it from the same parquet files. The views only
shape the tables into the schema an operator expects; all the operator's own
work runs in the library on top of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import column_rules_to_null
from ..session import cut_lineage
from ..sources.io import read_table

N_EMBED = 64
N_MODAL = 8

# Fixed values of the fixtures (FIXTURES.md): sentinel rules of F-nulls,
# the partial codebook, the flag definitions of F-flags.
NULL_RULES = {"l_tax": [0.0], "l_discount": [0.1], "l_linenumber": [1, 2]}
LOOKUP_ROWS = [("ECONOMY", "economy class"), ("LARGE", "large size"), ("PROMO", "promotional")]
FLAG_NAMES = ["flag_r", "flag_a", "flag_n", "flag_f", "flag_o", "flag_disc", "flag_qty"]


def _flag_conditions():
    return {
        "flag_r": F.col("l_returnflag") == "R",
        "flag_a": F.col("l_returnflag") == "A",
        "flag_n": F.col("l_returnflag") == "N",
        "flag_f": F.col("l_linestatus") == "F",
        "flag_o": F.col("l_linestatus") == "O",
        "flag_disc": F.col("l_discount") >= 0.08,
        "flag_qty": F.col("l_quantity") >= 45,
    }


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def f_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (t(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"),
               F.sum((F.col("l_returnflag") == "R").cast("int")).cast("bigint").alias("n_returned"),
               F.avg("l_quantity").alias("avg_qty"),
               F.avg("l_discount").alias("avg_disc"))
          .withColumnRenamed("l_orderkey", "o_orderkey"))
    o = t(spark, sf_dir, "orders")
    c = t(spark, sf_dir, "customer")
    n = t(spark, sf_dir, "nation")
    r = t(spark, sf_dir, "region")
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("o_orderkey", "o_orderstatus", "o_totalprice", "c_acctbal",
                     "c_mktsegment", "o_orderpriority", "r_name"))
    j = base.join(li, "o_orderkey", "left")
    outcome = F.coalesce(((F.col("o_orderstatus") == "F") & (F.col("n_returned") >= 1)).cast("int"),
                         F.lit(0))
    return j.select("o_orderkey", outcome.alias("outcome"), "o_totalprice", "c_acctbal",
                    "n_lines", "n_returned", "avg_qty", "avg_disc", "c_mktsegment",
                    "o_orderpriority", "r_name")


F_COHORT_SQL = """
f_cohort AS (
  SELECT o.o_orderkey,
         CASE WHEN o.o_orderstatus = 'F' AND li.n_returned >= 1 THEN 1 ELSE 0 END AS outcome,
         o.o_totalprice, c.c_acctbal, li.n_lines, li.n_returned, li.avg_qty, li.avg_disc,
         c.c_mktsegment, o.o_orderpriority, r.r_name
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned,
           avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc
    FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
)"""


def f_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    conds = _flag_conditions()
    li = (t(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(*[F.max(conds[k].cast("int")).alias(k) for k in FLAG_NAMES])
          .withColumnRenamed("l_orderkey", "o_orderkey"))
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(li, "o_orderkey", "left")
    flags = [F.coalesce(F.col(k), F.lit(0)).alias(k) for k in FLAG_NAMES]
    outcome = ((F.col("o_orderstatus") == "F") & (F.coalesce(F.col("flag_r"), F.lit(0)) == 1)).cast("int")
    return j.select("o_orderkey", outcome.alias("outcome"), *flags)


F_FLAGS_SQL = """
f_flags AS (
  SELECT o.o_orderkey,
         CASE WHEN o.o_orderstatus = 'F' AND coalesce(li.flag_r, 0) = 1 THEN 1 ELSE 0 END AS outcome,
         coalesce(li.flag_r, 0) AS flag_r, coalesce(li.flag_a, 0) AS flag_a,
         coalesce(li.flag_n, 0) AS flag_n, coalesce(li.flag_f, 0) AS flag_f,
         coalesce(li.flag_o, 0) AS flag_o, coalesce(li.flag_disc, 0) AS flag_disc,
         coalesce(li.flag_qty, 0) AS flag_qty
  FROM orders o LEFT JOIN (
    SELECT l_orderkey,
      max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flag_r,
      max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS flag_a,
      max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS flag_n,
      max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS flag_f,
      max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS flag_o,
      max(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS flag_disc,
      max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS flag_qty
    FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
)"""


def f_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber")
    return column_rules_to_null(li, NULL_RULES)


F_NULLS_SQL = """
f_nulls AS (
  SELECT l_quantity,
         CASE WHEN l_discount IN (0.1) THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_tax IN (0.0) THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE l_linenumber END AS l_linenumber
  FROM lineitem
)"""


def f_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per branch of the typing rules, at lineitem grain."""
    li = t(spark, sf_dir, "lineitem")
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    coded = column_rules_to_null(
        j.select(F.lit(1).alias("one"),
                 (F.col("l_returnflag") == "R").cast("int").alias("flag"),
                 "n_regionkey", "s_acctbal", "l_linenumber",
                 F.col("l_linenumber").alias("l_linecode"),
                 "l_quantity", "l_discount", "l_tax"),
        {"l_tax": NULL_RULES["l_tax"], "l_discount": NULL_RULES["l_discount"],
         "l_linecode": NULL_RULES["l_linenumber"]})
    return coded


F_PROFILE_SQL = """
f_profile AS (
  SELECT 1 AS one,
         CASE WHEN li.l_returnflag = 'R' THEN 1 ELSE 0 END AS flag,
         n.n_regionkey, s.s_acctbal, li.l_linenumber,
         CASE WHEN li.l_linenumber IN (1, 2) THEN NULL ELSE li.l_linenumber END AS l_linecode,
         li.l_quantity,
         CASE WHEN li.l_discount IN (0.1) THEN NULL ELSE li.l_discount END AS l_discount,
         CASE WHEN li.l_tax IN (0.0) THEN NULL ELSE li.l_tax END AS l_tax
  FROM lineitem li
  JOIN supplier s ON li.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


def embed_cols() -> list[str]:
    return [f"e{i}" for i in range(N_EMBED)]


def f_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_EMBED)],
                    F.col("label").isin(0, 1, 2).cast("int").alias("y"))


F_WIDE_SQL = (
    "\nf_wide AS (\n  SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(N_EMBED))
    + ", CASE WHEN label IN (0, 1, 2) THEN 1 ELSE 0 END AS y\n  FROM embeddings\n)"
)


def modal_names() -> list[str]:
    return [f"m{i}_score" for i in range(N_MODAL)]


def f_modal(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Eight (IID, SCORE) files; each misses the ids with vec_id % 97 == i,
    so the files cover different subjects, as the score files do."""
    w = f_wide(spark, sf_dir)
    return {
        name: w.where(F.col("vec_id") % 97 != i)
               .select(F.concat(F.lit("GWAS_ID_"), F.col("vec_id").cast("string")).alias("IID"),
                       F.col(f"e{8 * i}").alias("SCORE"))
        for i, name in enumerate(modal_names())
    }


def f_modal_sql(i: int) -> str:
    return (f"(SELECT 'GWAS_ID_' || CAST(vec_id AS VARCHAR) AS IID, e{8 * i} AS SCORE "
            f"FROM f_wide WHERE vec_id % 97 <> {i})")


def f_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey",
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    F.round(F.col("o_totalprice") / 500000.0, 2).alias("prob"),
                    (F.col("o_orderkey") % 10).cast("int").alias("fold"))


F_SCORED_SQL = """
f_scored AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         round(o_totalprice / 500000.0, 2) AS prob, CAST(o_orderkey % 10 AS INTEGER) AS fold
  FROM orders
)"""


def lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOOKUP_ROWS, "p_type string, label string")


LOOKUP_SQL = (
    "\nlookup AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in LOOKUP_ROWS)
    + ") AS v(p_type, label))"
)

VIEW_SQL = {
    "f_cohort": F_COHORT_SQL,
    "f_flags": F_FLAGS_SQL,
    "f_nulls": F_NULLS_SQL,
    "f_profile": F_PROFILE_SQL,
    "f_wide": F_WIDE_SQL,
    "f_scored": F_SCORED_SQL,
    "lookup": LOOKUP_SQL,
}


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs of the fixture views it uses."""
    if not views:
        return sql
    return "WITH " + ",".join(VIEW_SQL[v] for v in views) + "\n" + sql


def staged(df: DataFrame) -> DataFrame:
    """Write a derived view once to the shared checkpoint folder and read it
    back, as the reference stores its cleaned cohort before analysing it.
    Used where an operator reads its input several times (two-pass
    statistics), so the joins behind the view run once."""
    return cut_lineage(df)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)
