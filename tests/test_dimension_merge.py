"""One pass over batch and dimension, history that no load rewrites, ranks over many files."""

import glob
import os

import pytest

from carelake.operators import dimensions as dims
from carelake.operators import keys
from carelake.session import scratch_dir, scratch_scope
from carelake.sources.tables import TableStore
from tests.test_loads import DAY1, DAY2, patient, small, staged  # noqa: F401

DAY3 = "2024-09-01 02:00:00"


def counting(df):
    """``df`` and a counter of the rows read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_target_and_batch_are_read_once(spark, small):  # noqa: F811
    dim = dims.load_dim_patient(dims.sentinel_rows(spark, "DimPatient"), staged(spark, "patients", patient(), patient(patient_id="P2")),
                                small["DimPayer"], small["DimProvider"], DAY1)
    batch = dims.patient_source(staged(spark, "patients", patient(city="Elsewhere"), patient(patient_id="P3"), at=DAY2),
                                small["DimPayer"], small["DimProvider"])
    (target, read), (source, sent) = counting(dim), counting(batch)
    merge = dims.scd2_merge(target, source, DAY2)
    rows = merge.whole().collect()
    assert (read.value, sent.value) == (3, 2) and (merge.n_inserted, merge.n_updated) == (2, 1)
    assert sorted((r["PatientID"], r["IsCurrent"]) for r in rows if r["PatientKey"] > 1) == [("A", False), ("A", True), ("P2", True), ("P3", True)]
    assert sorted(r["PatientKey"] for r in rows) == [1, 2, 3, 4, 5]


def test_history_is_kept_apart(spark, small):  # noqa: F811
    store, whole = TableStore(spark, scratch_dir(spark, "history")), dims.sentinel_rows(spark, "DimPatient")
    load = lambda dim, city, at: dims.merge_dim_patient(
        dim, staged(spark, "patients", patient(city=city), patient(patient_id="P2"), at=at), small["DimPayer"], small["DimProvider"], at)
    closed = f"{store.root}/dw/DimPatient/closed"
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{closed.removeprefix('file:')}/load=*/part-*")}
    before, current = {}, whole
    for city, at in (("A", DAY1), ("B", DAY2), ("C", DAY3)):
        with scratch_scope(spark):
            merge = load(current, city, at)
            store.write_current(merge.standing.unionByName(merge.inserted), merge.closed, "dw", "DimPatient")
        whole, current = load(whole, city, at).whole(), store.read_current("dw", "DimPatient")
        assert before.items() <= files().items()
        before = files()
    table = store.read_table("dw", "DimPatient")
    assert sorted(map(str, table.collect())) == sorted(map(str, whole.select(table.columns).collect()))
    assert current.where("not IsCurrent").count() == 0 and table.where("not IsCurrent").count() == 2
    # a load that failed after its closed rows were written does not show
    table.limit(1).write.parquet(f"{closed}/load=4")
    assert store.read_table("dw", "DimPatient").count() == table.count() == 5
    with pytest.raises(ValueError):
        store.write_table(table, "dw", "DimPatient")


def test_scratch_of_a_scope_goes(spark):
    with scratch_scope(spark):
        path = scratch_dir(spark, "scoped")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(path.removeprefix("file:"))


def test_ranks_over_groups_of_files(spark, monkeypatch):
    monkeypatch.setattr(keys, "GROUP_FILES", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        ranked = keys.surrogate_keys(spark.range(1000).selectExpr("(id * 37) % 1000 AS x"), "k", "x", start=5)
        assert [(r["x"], r["k"]) for r in ranked.orderBy("x").collect()] == [(i, i + 6) for i in range(1000)]
        text = ranked._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("_group" in line for line in windows) and "Cross" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
