"""Session helpers: one place for the settings every operator relies on.

Nothing here creates a global session behind the caller's back; operators
take DataFrames and find the session through them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "cohortlab") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, ``master`` is left to spark-submit and the shared
    ``spark.checkpoint.dir`` comes from the cluster configuration; the
    local fallback below only applies where it is unset (tests).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Only takes effect when this call starts the JVM (local runs, tests).
        .config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. A local one is set only where none
    is configured and the master is local; a cluster must name its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join("/tmp", "cohortlab-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder (never machine-local
    on a cluster: the folder is the one the cluster names)."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/cohortlab-{name}-{uuid.uuid4().hex[:12]}"
    for written in _OPEN:
        written.append(path)
    return path


#: Paths given out inside each open ``stages`` block.
_OPEN: list[list[str]] = []


@contextmanager
def stages(spark: SparkSession) -> Iterator[list[str]]:
    """Own the stages that operators write inside the block: on leaving, their
    folders are deleted from the checkpoint folder. Results are lazy, so
    write or collect them inside."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield written
    finally:
        _OPEN[:] = [w for w in _OPEN if w is not written]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in written:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame, how: str = "table") -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from it.

    ``how="table"`` writes parquet under the folder and reads it back
    (columnar, compressed, and the planner sees real file sizes);
    ``how="checkpoint"`` uses ``DataFrame.checkpoint()``. Both survive the
    loss of an executor: later stages read the files, not the lineage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
