"""Column profiling and type inference.

A profile is one aggregate job whose result is one row per column; the
decisions taken from it are a driver-side dict and a single ``select``.
Wide frames are profiled in blocks so each aggregate stays inside
whole-stage codegen (``spark.sql.codegen.maxFields``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import column_quantiles, present

BLOCK = 60
#: Binary logarithm of the entries of a bounded distinct set.
SKETCH_LG = 6
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _blocks(cols: list[str], size: int = BLOCK):
    for i in range(0, len(cols), size):
        yield cols[i:i + size]


def _one_row(df: DataFrame, cols: list[str], fns: dict) -> dict[str, dict]:
    """Evaluate ``fns[name](col)`` for every column; returns {col: {name: v}}."""
    out: dict[str, dict] = {c: {} for c in cols}
    for block in _blocks(cols):
        exprs = []
        for j, c in enumerate(block):
            for name, fn in fns.items():
                exprs.append(fn(F.col(c)).alias(f"{name}__{j}"))
        row = df.agg(*exprs).first()
        for j, c in enumerate(block):
            for name in fns:
                out[c][name] = row[f"{name}__{j}"]
    return out


def _as_long(spark, prof: dict[str, dict], fields: list[tuple[str, str]]) -> DataFrame:
    schema = "column string, " + ", ".join(f"{n} {t}" for n, t in fields)
    rows = [(c, *[v[n] for n, _ in fields]) for c, v in prof.items()]
    return spark.createDataFrame(rows, schema)


def na_percent(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Percentage of NULL (or NaN) per column (one pass)."""
    cols = cols or df.columns
    row = df.agg(*[(F.avg((~present(df, c)).cast("double")) * 100.0).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "percent_missing")


def column_max(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Maximum per column, ascending (NULL maxima first)."""
    cols = cols or numeric_columns(df)
    row = df.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "max").orderBy(F.asc_nulls_first("max"), "column")


def column_nunique(df: DataFrame, cols: list[str] | None = None,
                   approx_rsd: float | None = None) -> DataFrame:
    """Distinct non-NULL values per column; ``approx_rsd`` switches to
    HyperLogLog++ (``approx_count_distinct``) for very large frames. The exact
    form counts the distinct (column, value) pairs, so each value is dealt
    out once however many rows hold it."""
    cols = cols or df.columns
    if approx_rsd:
        row = df.agg(*[F.approx_count_distinct(c, approx_rsd).cast("bigint").alias(c) for c in cols])
        return row.unpivot([], cols, "column", "nunique")
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    found = pairs.distinct().groupBy("column").agg(F.count("value").cast("bigint").alias("nunique"))
    return found


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values outside [Q1 - k IQR, Q3 + k IQR] per column.

    First exact quartiles of every column (``ranks.column_quantiles``), then
    one conditional count per column over the original frame, with
    the fences as literals (k rows were collected, one per column).
    """
    cols = cols or numeric_columns(df)
    q = column_quantiles(df, [], cols, [0.25, 0.75], ["q1", "q3"])
    fences = {r["column"]: (r["q1"], r["q3"]) for r in q.collect()}
    exprs = []
    for c in cols:
        q1, q3 = fences.get(c, (None, None))
        if q1 is None:
            exprs.append(F.lit(0).cast("bigint").alias(c))
            continue
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
        v = F.col(c).cast("double")
        exprs.append(F.count(F.when((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(1))).cast("bigint").alias(c))
    row = df.agg(*exprs)
    return row.unpivot([], cols, "column", "n_outliers")


def outlier_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """A6 + F9: names of columns with at least one outlier."""
    prof = iqr_outliers(df, cols)
    return [r["column"] for r in prof.where(F.col("n_outliers") >= 1).collect()]


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Columns with exactly one distinct non-NULL value: min = max decides it
    without a distinct shuffle (all-NULL columns have zero and are kept)."""
    cols = cols or df.columns
    prof = _one_row(df, cols, {"n": F.count, "lo": F.min, "hi": F.max})
    return [c for c in cols if prof[c]["n"] and prof[c]["lo"] == prof[c]["hi"]]


def drop_constant(df: DataFrame) -> DataFrame:
    """Keep columns whose number of distinct non-NULL values is not 1."""
    const = set(constant_columns(df))
    return df.select(*[c for c in df.columns if c not in const])


def sparse_columns(df: DataFrame, threshold: float = 0.2) -> list[str]:
    cols = df.columns
    prof = {r["column"]: r["percent_missing"] for r in na_percent(df, cols).collect()}
    return [c for c in cols if prof[c] is not None and prof[c] >= 100.0 * threshold]


def drop_sparse(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Keep columns with a missing share below ``threshold``."""
    sparse = set(sparse_columns(df, threshold))
    return df.select(*[c for c in df.columns if c not in sparse])


def distinct_sketch(c: Column) -> Column:
    """Bounded distinct set: a theta sketch keeps the values' hashes up to its
    nominal entries, and below that number its estimate is the exact count."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(c, SKETCH_LG))


def infer_types(df: DataFrame, cols: list[str] | None = None, cat_max: float = 7.0,
                float_min_distinct: int = 7, exact_counts: bool = True) -> DataFrame:
    """One decision per numeric column (rule D6):

    * ``boolean``  all non-NULL values in {0, 1} and max = 1;
    * ``category`` otherwise max <= 7 and fewer than 7 distinct values;
    * ``double``   otherwise.

    One pass gets max, the count of values outside {0, 1} and a bounded distinct
    set for all columns; no values are dealt out. ``n_distinct`` is given for
    columns that the maximum leaves open. Of those with 64 values or more, which
    are ``double`` whatever their number, it is counted by ``column_nunique``, or left
    NULL with ``exact_counts=False``.
    """
    cols = cols or numeric_columns(df)
    if float_min_distinct > 1 << SKETCH_LG:
        raise ValueError(f"float_min_distinct: at most {1 << SKETCH_LG}")
    p1 = _one_row(df, cols, {
        "max": lambda c: F.max(c.cast("double")),
        "nonbin": lambda c: F.count(F.when(~c.cast("double").isin(0.0, 1.0), F.lit(1))),
        "few": lambda c: distinct_sketch(c.cast("double")),
    })
    cand = [c for c in cols if p1[c]["max"] is not None and p1[c]["max"] <= cat_max
            and not (p1[c]["nonbin"] == 0 and p1[c]["max"] == 1.0)]
    p2 = {c: {"nd": p1[c]["few"]} for c in cand}
    many = [c for c in cand if p1[c]["few"] >= 1 << SKETCH_LG]
    if many:
        counts = {r["column"]: r["nunique"] for r in column_nunique(df, many).collect()} if exact_counts else {}
        p2 |= {c: {"nd": counts.get(c)} for c in many}
    rows = []
    for c in cols:
        mx, nonbin = p1[c]["max"], p1[c]["nonbin"]
        nd = p2.get(c, {}).get("nd")
        if mx is not None and nonbin == 0 and mx == 1.0:
            kind = "boolean"
        elif nd is not None and nd < float_min_distinct:
            kind = "category"
        else:
            kind = "double"
        rows.append((c, mx, nd, kind))
    return df.sparkSession.createDataFrame(
        rows, "column string, max double, n_distinct bigint, inferred string")


def apply_types(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """Apply Y1-Y3 decisions in one select. Boolean keeps NULL (D5);
    category becomes an integer column marked nominal in its metadata."""

    def conv(c: str) -> Column:
        kind = decisions.get(c)
        if kind == "boolean":
            return (F.col(c) != 0).alias(c)
        if kind == "category":
            return F.col(c).cast("int").alias(c, metadata={"ml_attr": {"type": "nominal", "name": c}})
        if kind == "double":
            return F.col(c).cast("double").alias(c)
        return F.col(c)

    return df.select(*[conv(c) for c in df.columns])
