"""Sources and sinks: CSV with a checked header, the index artefact, the
format switch and the per-modality sink."""

import pytest

from cohortlab.session import scratch_path
from cohortlab.sources import io


def test_csv_roundtrip_and_header_check(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, x double")
    path = io.write_csv(df, scratch_path(spark, "t-csv"))
    back = io.read_csv(spark, path, "k int, s string, x double")
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(Exception):
        io.read_csv(spark, path, "k int, wrong string, x double").collect()


def test_index_artefact_and_format_switch(spark):
    df = spark.createDataFrame([(0, 1, 2.0)], "`Unnamed: 0` int, k int, x double")
    assert io.drop_index_artefact(df).columns == ["k", "x"]
    assert io.drop_index_artefact(df.drop("Unnamed: 0")).columns == ["k", "x"]
    base = scratch_path(spark, "t-mod")
    paths = io.write_modalities(df.drop("Unnamed: 0").withColumn("y", df.x * 2), base,
                                {"m1": ["x"], "m2": ["y"]}, keep=["k"])
    assert io.load(spark, paths["m1"], "parquet").columns == ["k", "x"]
    assert io.load(spark, paths["m2"]).first()["y"] == 4.0
