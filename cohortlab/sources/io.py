"""Sources and sinks.

All readers are lazy ``spark.read`` calls, so column pruning and filter
pushdown reach the file scan. CSV is read with an explicit schema where one
is known; ``enforceSchema=False`` makes Spark check the header against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Column left behind by writers that store the row index.
INDEX_ARTEFACTS = ("_c0", "Unnamed: 0")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN, the missing marker of the files, becomes NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def read_table(spark: SparkSession, sf_dir: str, name: str, nan_is_null: bool = False) -> DataFrame:
    """S3: one parquet table of the test data. Its writer knows NULL, so NaN
    is left alone unless asked for: rewriting a column would keep filters on
    it from the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return nan_to_null(df) if nan_is_null else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with header. With a schema the header is checked, not trusted.
    NaN is read as NULL."""
    reader = spark.read.option("header", str(header).lower()).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", "false")
    else:
        reader = reader.option("inferSchema", "true")
    return nan_to_null(drop_index_artefact(reader.csv(path)))


def load(spark: SparkSession, path: str, fmt: str = "parquet",
         schema: T.StructType | str | None = None) -> DataFrame:
    """Format switch (the reference's ``pkl=True/False`` flag). NaN is read as NULL."""
    if fmt == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def drop_index_artefact(df: DataFrame) -> DataFrame:
    """Drop a stored row-index column; no error when it is absent."""
    return df.drop(*[c for c in INDEX_ARTEFACTS if c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    """CSV sink with header, one folder of part files."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    """Columnar sink."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_modalities(df: DataFrame, base: str, groups: dict[str, list[str]],
                     keep: list[str]) -> dict[str, str]:
    """One parquet folder per modality (its columns plus ``keep``)."""
    out = {}
    for name, cols in groups.items():
        out[name] = write_parquet(df.select(*keep, *cols), f"{base.rstrip('/')}/{name}")
    return out
