import json

from pyspark.sql import functions as F

from carelake.plans.etl import Etl
from carelake.schemas import ENTITIES, STAGING_COLUMNS
from carelake.session import scratch_dir
from carelake.sources import export, landing
from carelake.sources import testdata as td
from carelake.sources.tables import TableStore
from carelake.streaming.landing import landing_stream


def test_nested_lab_array(spark, tmp_path):
    record = {"lab_id": "L1", "patient_id": "P", "order_date": "2024-01-01", "result": {
        "test_name": "CRP", "loinc_code": "1988-5", "value": 6.55, "unit": "mg/L",
        "reference_range": {"low": 0.0, "high": 3.0}, "flag": "Critical", "result_date": "2024-01-02"}}
    (tmp_path / "labs.json").write_text(json.dumps([record, {**record, "lab_id": "L2"}], indent=2))
    rows = landing.read_labs_json(spark, str(tmp_path / "labs.json")).orderBy("lab_id").collect()
    assert [r.lab_id for r in rows] == ["L1", "L2"]
    assert (rows[0].result_value, rows[0].reference_range_high, rows[0].abnormal_flag, rows[0].provider_id) == (
        "6.55", "3.0", "Critical", None)


def test_csv_keeps_bad_lines(spark, tmp_path):
    folder = tmp_path / "payers"
    folder.mkdir()
    names = ",".join(landing.STAGING_COLUMNS["payers"])
    (folder / "payers_20240101.csv").write_text(f"{names}\n" + ",".join("abcdefghijk") + "\nx,y\n")
    df = landing.read_landing_csv(spark, "payers", "20240101", str(tmp_path)).cache()
    assert df.count() == 2 and df.where(F.col("_corrupt_record").isNotNull()).count() == 1
    staged = landing.stage(landing.read_landing_csv(spark, "payers", "20240101", str(tmp_path)), "payers")
    assert staged.first().stg_source_file.endswith("payers_20240101.csv") and staged.count() == 1
    bad = landing.bad_lines(landing.read_landing_csv(spark, "payers", "20240101", str(tmp_path)), "payers").collect()
    assert [(r.source_file.endswith("payers_20240101.csv"), r.raw) for r in bad] == [(True, "x,y")]


def test_edi_files_hold_whole_interchanges_in_order(spark, sf, tmp_path):
    claims = td.landing(spark, sf, "claims")
    export.export_edi_837(claims, "2024-06-01 07:30:00", str(tmp_path / "edi"))
    batches = []
    for part in sorted((tmp_path / "edi").glob("part-*")):
        for line in part.read_text().splitlines():
            kind = line.split("*")[0]
            if kind == "ISA":
                batches.append([])
            batches[-1].append(line)
    n = claims.count()
    assert len(batches) == -(-n // 1000)
    for b in batches:
        kinds = [x.split("*")[0] for x in b]
        assert kinds[:2] == ["ISA", "GS"] and kinds[-2:] == ["GE", "IEA"]
        per_claim = ["ST", "BHT", "NM1", "SBR", "NM1", "CLM", "DTP", "HI", "NM1", "LX", "SV1", "DTP", "SE"]
        assert kinds[2:-2] == per_claim * ((len(kinds) - 4) // 13)
        assert b[-2].split("*")[1] == str((len(kinds) - 4) // 13)


def test_store_versions_survive_self_rewrite(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write_table(spark.range(3), "rpt", "t")
    store.write_table(store.read_table("rpt", "t").withColumn("id", F.col("id") + 1), "rpt", "t")
    assert sorted(r.id for r in store.read_table("rpt", "t").collect()) == [1, 2, 3]
    store.write_table(spark.range(1), "rpt", "t", append=True)
    assert store.read_table("rpt", "t").count() == 4


def test_landing_stream_loads_each_file_once(spark, sf):
    root = scratch_dir(spark, "stream-test")
    for entity in ENTITIES:
        td.landing(spark, sf, entity).write.option("header", True).csv(f"{root}/landing/{entity}")
    etl = Etl(spark, f"{root}/warehouse", td.CALENDAR)
    run = lambda: {r.Entity: r.RowsInserted for r in landing_stream(
        spark, f"{root}/landing", f"{root}/checkpoint", etl, "2024-06-01 00:00:00").collect()}
    first = run()
    assert first["FactClaims"] == td.landing(spark, sf, "claims").select("claim_id").distinct().count()
    assert set(run().values()) == {0}
    more = td.landing(spark, sf, "claims").limit(50)
    more.unionByName(more.limit(10).withColumn("claim_id", F.concat(F.lit("new"), F.col("claim_id")))).write.mode(
        "append").option("header", True).csv(f"{root}/landing/claims")
    third = run()
    assert third["FactClaims"] == 10 and sum(third.values()) == 10
    # a new checkpoint is a new stream: its first batch replaces none of the old one's
    row = ",".join(["P2", "Two", "Medicare", *[""] * 7, "2024-01-01 00:00:00"])
    extra = spark.createDataFrame([(",".join(STAGING_COLUMNS["payers"]) + "\n" + row + "\nbroken,line",)], "value string")
    extra.coalesce(1).write.mode("append").text(f"{root}/landing/payers")
    again = landing_stream(spark, f"{root}/landing", f"{root}/checkpoint2", etl, "2024-06-02 00:00:00").collect()
    assert {r.Entity: r.RowsInserted for r in again}["DimPayer"] == 1
    assert [r.raw for r in etl.staging.rejected().where("entity = 'payers'").collect()] == ["broken,line"]
