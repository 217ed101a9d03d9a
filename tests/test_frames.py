"""Frame operators: join fold, key exclusion paths, lookup join, typing."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import scalar as S
from cohortlab.operators import columns as P
from cohortlab.operators import joins as J
from cohortlab.operators import profile as PR
from cohortlab.operators import rows as R


def test_join_fold_inner_and_duplicates(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, v double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0), (4, 40.0)], "id long, v double")
    out = {r.id: (r.a, r.b) for r in J.join_fold({"a": a, "b": b}, "id", "v").collect()}
    assert out == {2: (2.0, 20.0), 3: (3.0, 30.0)}
    dup = b.unionByName(spark.createDataFrame([(3, 31.0)], "id long, v double"))
    with pytest.raises(Exception, match="duplicate"):
        J.join_fold({"a": a, "b": dup}, "id", "v").collect()


def test_exclude_keys_both_paths(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    short = R.exclude_keys(df, "k", [1, 2, 3])
    long = R.exclude_keys(df, "k", list(range(0, 5000, 2)))
    assert short.count() == 4997
    assert long.count() == 2500 and long.where(F.col("k") % 2 == 0).count() == 0


def test_lookup_and_parse(spark):
    df = spark.createDataFrame([("GWAS_ID_12", "x"), ("GWAS_ID_bad", "y")], "iid string, t string")
    parsed = df.select(S.parse_key("iid", 8).alias("k")).collect()
    assert [r.k for r in parsed] == [12, None]
    lk = spark.createDataFrame([("x", "ex")], "t string, label string")
    got = {r.t: r.label for r in J.lookup_join(df, lk, "t", "label").collect()}
    assert got == {"x": "ex", "y": "fehlt"}


def test_prefix_clash_and_range(spark):
    df = spark.createDataFrame([(1, 2, 3)], "s0_a int, a int, s0_b int")
    with pytest.raises(ValueError):
        P.strip_prefix(df, "s0_")
    assert P.select_range(df, "a", "s0_b").columns == ["a", "s0_b"]


def test_typing_rules(spark):
    rows = [(0, 1.0, 1, 0.5, None), (1, 0.0, 3, 7.0, 1.0), (1, None, 5, 2.0, None), (0, 1.0, 7, 9.0, None)]
    df = spark.createDataFrame(rows, "b int, bn double, cat int, f double, sparse double")
    d = {r.column: r.inferred for r in PR.infer_types(df).collect()}
    assert d == {"b": "boolean", "bn": "boolean", "cat": "category", "f": "double", "sparse": "boolean"}
    typed = PR.apply_types(df, d)
    assert dict(typed.dtypes)["b"] == "boolean" and dict(typed.dtypes)["f"] == "double"
    assert typed.where(F.col("bn").isNull()).count() == 1  # NULL stays NULL (D5)
