"""Shared helpers of the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortlab.session import cut_lineage, ensure_checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the test layout."""
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back."""
    return cut_lineage(df, "table")


class Stage:
    """A frame written to the shared checkpoint folder, to be dropped by its owner when nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, "stage")
        df.write.parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, one object a row."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that the Python objects of few texts live at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave the first time it was asked for in this worker process.

    Task code arrives by value, so its globals are new in every task; tables
    that later tasks of the worker can use again live in a module of their own.
    """
    state = sys.modules.setdefault("_text_operator_state", types.ModuleType("_text_operator_state")).__dict__
    if key not in state:
        state[key] = make()
    return state[key]
