import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelake.operators import dimensions as dims
from carelake.operators import facts, keys, quality
from carelake.operators.lookups import DuplicateKeys, resolve_duplicates
from carelake.plans.etl import STEPS, Etl
from carelake.plans.views import vw_claims_summary
from carelake.schemas import ENTITIES, STAGING_COLUMNS, empty_table
from carelake.session import scratch_dir
from carelake.sources import testdata as td
from carelake.sources.landing import stage

DAY1, DAY2 = "2024-06-01 00:00:00", "2024-06-02 00:00:00"


def staged(spark, entity, *rows, at=DAY1):
    columns = STAGING_COLUMNS[entity]
    data = [tuple(r.get(c) for c in columns) for r in rows]
    raw = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    return stage(raw, entity, f"{entity}.csv", at)


def patient(pid="A", **changes):
    base = dict(patient_id=pid, first_name="Ann", last_name="Lee", date_of_birth="1980-02-03", gender="F",
                address="1 Elm", city="Rome", state="OH", zip_code="1", primary_payer_id="PY",
                primary_provider_id="PR", created_at="2024-01-01 00:00:00")
    return {**base, **changes}


@pytest.fixture(scope="module")
def small(spark):
    facility = dims.load_dim_facility(dims.sentinel_rows(spark, "DimFacility"), staged(
        spark, "facilities", dict(facility_id="FA", facility_name="Clinic", facility_type="Clinic", bed_count="")), DAY1)
    payer = dims.load_dim_payer(dims.sentinel_rows(spark, "DimPayer"), staged(
        spark, "payers", dict(payer_id="PY", payer_name="One", payer_type="Medicare")), DAY1)
    provider = dims.load_dim_provider(dims.sentinel_rows(spark, "DimProvider"), staged(
        spark, "providers", dict(provider_id="PR", first_name="Bo", last_name="Fox", facility_id="nowhere",
                                 years_experience="")), facility, DAY1)
    return {"DimFacility": facility, "DimPayer": payer, "DimProvider": provider,
            "DimDate": dims.build_dim_date(spark, "2024-01-01", "2024-12-31"), **dims.reference_dims(spark)}


def load_patients(spark, small, dim, *rows, at=DAY1, **how):
    return dims.load_dim_patient(dim, staged(spark, "patients", *rows, at=at), small["DimPayer"],
                                 small["DimProvider"], at, **how)


def versions(df, pid="A"):
    return [tuple(r) for r in df.where(F.col("PatientID") == pid).orderBy("PatientKey").select(
        "City", "IsCurrent", "EffectiveDate", "ExpirationDate").collect()]


def test_sentinels_and_unknown_lookups(small):
    assert small["DimDate"].where("DateKey = 0").count() == 1 and small["DimDate"].count() == 367
    got = {r.ProviderID: (r.ProviderKey, r.FacilityKey, r.YearsExperience) for r in small["DimProvider"].collect()}
    assert got["PR"] == (2, 1, None)
    assert [d.count() for d in (small["DimDiagnosis"], small["DimProcedure"], small["DimDrug"])] == [16, 11, 11]


def test_scd1_overwrites_and_keeps_key_and_creation(spark, small):
    row = dict(payer_id="PY", payer_name=None, payer_type="Medicaid", created_at="2030-01-01 00:00:00")
    new = dims.load_dim_payer(small["DimPayer"], staged(spark, "payers", row, dict(payer_id="PZ", payer_name="Z")), DAY2)
    got = {r.PayerID: r for r in new.collect()}
    assert (got["PY"].PayerKey, got["PY"].PayerName, got["PY"].PayerType, got["PY"].CreatedAt) == (2, None, "Medicaid", None)
    assert got["PY"].DWUpdatedAt == dt.datetime(2024, 6, 2) and got["PZ"].PayerKey == 3 and len(got) == 3


def test_scd2_new_changed_unchanged(spark, small):
    start = dims.sentinel_rows(spark, "DimPatient")
    one = load_patients(spark, small, start, patient(), patient("B"))
    assert versions(one) == [("Rome", True, dt.date(2024, 6, 1), None)]
    again = load_patients(spark, small, one, patient(first_name="Other", phone="5"), patient("B"), at=DAY2)
    assert again.count() == one.count() and again.where("FirstName = 'Other'").count() == 0
    moved = load_patients(spark, small, one, patient(city="Oslo"), patient("B"), at=DAY2)
    assert versions(moved) == [("Rome", False, dt.date(2024, 6, 1), dt.date(2024, 6, 1)),
                               ("Oslo", True, dt.date(2024, 6, 2), None)]
    assert len(versions(moved, "B")) == 1


def test_scd2_unknown_payer_is_not_versioned_again(spark, small):
    start = dims.sentinel_rows(spark, "DimPatient")
    one = load_patients(spark, small, start, patient(primary_payer_id="gone"))
    two = load_patients(spark, small, one, patient(primary_payer_id="gone", address="1 Elm"), at=DAY2)
    assert len(versions(two)) == 1


def test_blank_and_missing_are_the_same(spark, small):
    start = dims.sentinel_rows(spark, "DimPatient")
    one = load_patients(spark, small, start, patient(city=None))
    assert len(versions(load_patients(spark, small, one, patient(city=""), at=DAY2))) == 1


def test_one_current_version_over_many_loads(spark, small):
    dim = dims.sentinel_rows(spark, "DimPatient")
    for i, city in enumerate(["a", "b", "b", "c", "a"]):
        dim = load_patients(spark, small, dim, patient(city=city), patient("B", city="x"), at=f"2024-06-0{i + 1} 00:00:00")
        dim = dim.checkpoint() if spark.sparkContext.getCheckpointDir() else dim
    got = versions(dim)
    assert [g[0] for g in got] == ["a", "b", "c", "a"] and sum(g[1] for g in got) == 1
    for before, after in zip(got, got[1:]):
        assert before[3] < after[2]
    assert dim.select("PatientKey").distinct().count() == dim.count()


def test_duplicates(spark, small):
    start = dims.sentinel_rows(spark, "DimPatient")
    with pytest.raises(DuplicateKeys):
        load_patients(spark, small, start, patient(), patient(city="Oslo"), on_duplicate="error")
    two = staged(spark, "patients", patient(), at=DAY1).unionByName(staged(spark, "patients", patient(city="Oslo"), at=DAY2))
    kept = resolve_duplicates(two, "patient_id", "keep_latest", dims.LATEST)
    assert [r.city for r in kept.collect()] == ["Oslo"]
    with pytest.raises(ValueError):
        resolve_duplicates(two, "patient_id", "whatever", dims.LATEST)


def claim(cid="K1", **changes):
    base = dict(claim_id=cid, patient_id="A", provider_id="PR", facility_id="FA", payer_id="PY", claim_date="20240110",
                service_date="2024-01-05", icd10_primary="I10", procedure_code="nope", billed_amount="100.005",
                allowed_amount="80", paid_amount="bad", claim_status="Approved", denial_reason="")
    return {**base, **changes}


def test_fact_claims_rules(spark, small):
    patients = load_patients(spark, small, dims.sentinel_rows(spark, "DimPatient"), patient())
    tables = {**small, "DimPatient": patients}
    rows = staged(spark, "claims", claim(), claim("K2", patient_id="?", service_date="2024-02-30", claim_date="1999-01-01"))
    fact = facts.load_fact_claims(empty_table(spark, "FactClaims"), rows, tables, DAY1)
    got = {r.ClaimID: r for r in fact.collect()}
    k1, k2 = got["K1"], got["K2"]
    assert (k1.ServiceDateKey, k1.ClaimDateKey, k1.ProcedureKey, k1.DiagnosisKey) == (20240105, 20240110, 1, 3)
    assert (str(k1.BilledAmount), str(k1.PaidAmount), str(k1.WriteOffAmount)) == ("100.01", "0.00", "80.00")
    assert k1.DenialReason is None and k2.PatientKey == 1
    assert (k2.ServiceDateKey, k2.ClaimDateKey, k2.PartitionYear) == (0, 0, 0)
    again = facts.load_fact_claims(fact, rows, tables, DAY2)
    assert again.count() == 0
    view = vw_claims_summary({**tables, "FactClaims": fact})
    assert {r.ClaimID: r.PatientAgeAtService for r in view.collect()} == {"K1": 44, "K2": None}
    both = staged(spark, "claims", claim("K3"), claim("K3", billed_amount="7"))
    assert facts.load_fact_claims(fact, both, tables, DAY2).count() == 1
    with pytest.raises(DuplicateKeys):
        facts.load_fact_claims(fact, both, tables, DAY2, on_duplicate="error")


def test_expired_version_hides_fact_unless_followed_by_id(spark, small):
    one = load_patients(spark, small, dims.sentinel_rows(spark, "DimPatient"), patient())
    fact = facts.load_fact_claims(empty_table(spark, "FactClaims"), staged(spark, "claims", claim()),
                                  {**small, "DimPatient": one}, DAY1)
    two = load_patients(spark, small, one, patient(city="Oslo", state="TX"), at=DAY2)
    tables = {**small, "DimPatient": two, "FactClaims": fact}
    assert vw_claims_summary(tables).count() == 0
    assert [r.PatientState for r in vw_claims_summary(tables, "current_by_id").collect()] == ["TX"]


def test_case_insensitive_lookup(spark, small):
    patients = load_patients(spark, small, dims.sentinel_rows(spark, "DimPatient"), patient())
    rows = staged(spark, "claims", claim(icd10_primary="i10", provider_id="pr"))
    tables = {**small, "DimPatient": patients}
    exact = facts.load_fact_claims(empty_table(spark, "FactClaims"), rows, tables, DAY1).first()
    loose = facts.load_fact_claims(empty_table(spark, "FactClaims"), rows, tables, DAY1, ci=True).first()
    assert (exact.DiagnosisKey, exact.ProviderKey) == (1, 1) and (loose.DiagnosisKey, loose.ProviderKey) == (3, 2)


def test_surrogate_keys_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    got = keys.surrogate_keys(df, "k", "x", start=10).orderBy("x").collect()
    assert [r.k for r in got] == list(range(11, 5011)) and [r.x for r in got] == list(range(5000))
    assert keys.surrogate_keys(df.where("x < 0"), "k", "x").count() == 0


def test_batches_are_full_but_the_last(spark):
    df = spark.range(0, 2500, 1, 5).select(F.format_string("%05d", "id").alias("x"))
    got = keys.batch_numbering(df, "x", 1000).groupBy("batch").agg(F.count("x").alias("n"), F.min("x").alias("lo"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1000, "00000"), (2, 1000, "01000"), (3, 500, "02000")]


def test_one_hot_claim_id_with_many_copies(spark, small):
    """A third of the batch is one claim id; one row of it is loaded."""
    patients = load_patients(spark, small, dims.sentinel_rows(spark, "DimPatient"), patient())
    row = staged(spark, "claims", claim())
    n = spark.range(0, 6000, 1, 8)
    batch = row.crossJoin(n).withColumn("claim_id", F.when(F.col("id") % 3 == 0, "HOT").otherwise(
        F.concat(F.lit("K"), F.col("id").cast("string")))).drop("id")
    fact = facts.load_fact_claims(empty_table(spark, "FactClaims"), batch, {**small, "DimPatient": patients}, DAY1)
    assert fact.count() == 4001 and fact.where("ClaimID = 'HOT'").count() == 1


def test_integrity_report_is_clean_on_a_fresh_warehouse(wh):
    tables = wh.tables("DimDate", "DimPayer", "DimFacility", "DimProvider", "DimPatient", "DimDiagnosis", "DimProcedure",
                       "DimDrug", "FactClaims", "FactLabResults", "FactPrescriptions", "FactFinancials")
    report = quality.integrity_report(tables)
    assert report.count() > 50 and report.where("violations > 0").count() == 0


def test_failed_step_stops_run_and_marks_batch(spark, sf, monkeypatch):
    etl = Etl(spark, scratch_dir(spark, "etl-fail"), td.CALENDAR)
    for entity in ENTITIES:
        etl.staging.add(td.staged(spark, sf, entity), entity, "1")
    real = dims.merge_dim_provider
    monkeypatch.setattr(dims, "merge_dim_provider", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("broken file")))
    with pytest.raises(RuntimeError):
        etl.run_all(DAY1)
    log = {r.Entity: (r.Status, r.ErrorMessage) for r in etl.log.read().collect()}
    assert log == {"DimPayer": ("Success", None), "DimFacility": ("Success", None), "DimProvider": ("Error", "broken file")}
    assert {r.stg_status for r in etl.staging.read("providers").select("stg_status").distinct().collect()} == {"Error"}
    assert etl.staging.pending("claims") == ["1"] and etl.staging.pending("payers") == []
    monkeypatch.setattr(dims, "merge_dim_provider", real)
    etl.staging.add(td.staged(spark, sf, "providers"), "providers", "2")
    summary = {r.Entity: r.RowsInserted for r in etl.run_all(DAY2).collect()}
    assert list(summary) == list(STEPS) and summary["DimPayer"] == 0 and summary["FactClaims"] > 5000
