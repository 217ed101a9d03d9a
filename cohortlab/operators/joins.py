"""Equi-joins on one key.

Spark picks the physical join: a side that it finds (or, with AQE on, has
measured to be) below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast,
any other join stays sort-merge. No join here carries a hint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_key


def join_inner(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner equi-join; Spark/AQE choose broadcast or sort-merge."""
    return left.join(right, key, "inner")


def join_fold(parts: dict[str, DataFrame], key: str, value: str,
              require_all: bool = True) -> DataFrame:
    """Inner join of N (key, value) frames, one column per frame.

    Instead of N-1 joins (N-1 shuffles of a growing frame) the parts are
    tagged, unioned and folded with one conditional aggregation per key:
    a single shuffle with map-side partial aggregation. Inner-join semantics
    need each part to have unique keys; a duplicate key raises at run time.
    Rows with a NULL key join nothing and are left out.
    """
    names = list(parts)
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(F.col(key), F.col(value).cast("double").alias("_v"),
                   F.lit(n).alias("_src")).where(F.col(key).isNotNull()) for n, df in parts.items()],
    )
    aggs = []
    for n in names:
        hit = F.col("_src") == n
        aggs.append(F.max(F.when(hit, F.col("_v"))).alias(n))
        aggs.append(F.count(F.when(hit, F.lit(1))).alias(f"_n_{n}"))
    wide = tagged.groupBy(key).agg(*aggs)
    counts = [F.col(f"_n_{n}") for n in names]
    dup = reduce(lambda a, b: a | b, [c > 1 for c in counts])
    check = F.when(dup, F.raise_error(F.lit(f"join_fold: duplicate {key} in a part"))) \
        .otherwise(F.lit(True))
    present = reduce(lambda a, b: a & b, [c >= 1 for c in counts]) if require_all else F.lit(True)
    return wide.where(check & present).select(key, *names)


def parse_and_fold(parts: dict[str, DataFrame], id_col: str, value_col: str,
                   offset: int, key: str = "id", shift: int = 0) -> DataFrame:
    """J2 as the reference uses it: per file keep (id, score), parse the key
    from its string id (C1), then fold; finally shift the key (P13).
    Malformed ids have no key and are left out; ``parse_rejects`` counts them."""
    parsed = {
        n: df.select(parse_key(F.col(id_col), offset).alias(key), F.col(value_col))
        for n, df in parts.items()
    }
    out = join_fold(parsed, key, value_col)
    return out.withColumn(key, F.col(key) + F.lit(shift)) if shift else out


def parse_rejects(parts: dict[str, DataFrame], id_col: str, offset: int) -> DataFrame:
    """``(part, n_rejected)``, the rows of each file whose id gives no key."""
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("part"), parse_key(F.col(id_col), offset).isNull().cast("bigint").alias("bad"))
        for n, df in parts.items()])
    return tagged.groupBy("part").agg(F.sum("bad").alias("n_rejected"))


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, label: str,
                missing: str = "fehlt") -> DataFrame:
    """J3 + C14: left join to a lookup table, misses filled with a constant."""
    lk = lookup.select(key, label)
    return df.join(lk, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(missing)))
