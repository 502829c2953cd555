"""Landing files that queries write are compressed; what is read from them is the same."""

import glob

import pytest

import __spark_entry__


@pytest.mark.parametrize("query,label", [("read_prescriptions_json", "rx-json"), ("landing_stream", "stream")])
def test_landing_files_are_compressed(spark, sf, query, label):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    pattern = f"{base.removeprefix('file:')}/carelake/{spark.sparkContext.applicationId}/{label}-*"
    before = set(glob.glob(pattern))
    assert __spark_entry__.queries()[query](spark, sf).count() > 0
    made, = set(glob.glob(pattern)) - before
    files = glob.glob(f"{made}/part-*") + glob.glob(f"{made}/landing/*/part-*")
    assert files and all(f.endswith(".gz") for f in files)
