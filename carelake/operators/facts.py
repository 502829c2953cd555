"""Fact loads: cast, look up keys, keep only unseen natural ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions.predicates import _instant, current_only, pending_only
from carelake.functions.scalars import (blank_to_null, date_key, deviation_from_mid, total_cost, typed_cast,
                                        write_off)
from carelake.operators.dimensions import LATEST
from carelake.operators.id_index import IdIndex
from carelake.operators.keys import max_key, one_pass_keys
from carelake.operators.lookups import (anti_existing, latest_of_batch, lookup_or_unknown, repeated_hashes,
                                        resolve_duplicates)
from carelake.schemas import SURROGATE_KEY, conform, empty_table

CODE_LISTS = ("DimDiagnosis", "DimProcedure", "DimDrug")

# staging id column -> (dimension, natural id, surrogate key)
LOOKUPS = {
    "FactClaims": {
        "patient_id": ("DimPatient", "PatientID", "PatientKey"),
        "provider_id": ("DimProvider", "ProviderID", "ProviderKey"),
        "facility_id": ("DimFacility", "FacilityID", "FacilityKey"),
        "payer_id": ("DimPayer", "PayerID", "PayerKey"),
        "icd10_primary": ("DimDiagnosis", "ICD10Code", "DiagnosisKey"),
        "procedure_code": ("DimProcedure", "CPTCode", "ProcedureKey"),
    },
    "FactLabResults": {
        "patient_id": ("DimPatient", "PatientID", "PatientKey"),
        "provider_id": ("DimProvider", "ProviderID", "ProviderKey"),
        "facility_id": ("DimFacility", "FacilityID", "FacilityKey"),
    },
    "FactPrescriptions": {
        "patient_id": ("DimPatient", "PatientID", "PatientKey"),
        "provider_id": ("DimProvider", "ProviderID", "ProviderKey"),
        "payer_id": ("DimPayer", "PayerID", "PayerKey"),
        "ndc_code": ("DimDrug", "NDCCode", "DrugKey"),
    },
    "FactFinancials": {"facility_id": ("DimFacility", "FacilityID", "FacilityKey")},
}


def _amount(col: str, dtype: str = "decimal(10,2)") -> Column:
    return F.coalesce(typed_cast(col, dtype), F.lit(0).cast(dtype))


def _claims() -> dict[str, Column]:
    return {
        "ServiceDateKey": date_key("service_date"), "ClaimDateKey": date_key("claim_date"),
        "BilledAmount": _amount("billed_amount"), "AllowedAmount": _amount("allowed_amount"),
        "PaidAmount": _amount("paid_amount"),
        "ClaimStatus": F.col("claim_status"), "DenialReason": blank_to_null("denial_reason"),
    }


def _labs() -> dict[str, Column]:
    value, low, high = (typed_cast(c, "decimal(10,3)") for c in
                        ("result_value", "reference_range_low", "reference_range_high"))
    return {
        "OrderDateKey": date_key("order_date"), "ResultDateKey": date_key("result_date"),
        "TestName": F.col("test_name"), "LOINCCode": F.col("loinc_code"), "AbnormalFlag": F.col("abnormal_flag"),
        "ResultValue": value, "ResultUnit": F.col("result_unit"), "ReferenceRangeLow": low,
        "ReferenceRangeHigh": high,
    }


def _prescriptions() -> dict[str, Column]:
    patient, payer = (typed_cast(c, "decimal(10,2)") for c in ("cost_to_patient", "cost_to_payer"))
    return {
        "PrescribedDateKey": date_key("prescribed_date"), "FillDateKey": date_key("fill_date"),
        "DaysSupply": typed_cast("days_supply", "smallint"), "Quantity": typed_cast("quantity", "smallint"),
        "RefillsAuthorized": typed_cast("refills_authorized", "tinyint"),
        "RefillsRemaining": typed_cast("refills_remaining", "tinyint"),
        "CostToPatient": patient, "CostToPayer": payer,
    }


def _financials() -> dict[str, Column]:
    return {
        "TransactionDateKey": date_key("transaction_date"), "TransactionType": F.col("transaction_type"),
        "Department": F.col("department"), "CostCenter": F.col("cost_center"), "GLAccount": F.col("gl_account"),
        "Description": F.col("description"), "Amount": _amount("amount", "decimal(15,2)"),
        "FiscalYear": typed_cast("fiscal_year", "smallint"), "FiscalQuarter": typed_cast("fiscal_quarter", "tinyint"),
    }


#: Columns that follow from others of the row: added after the lookups, so they are not moved.
DERIVED = {
    "FactClaims": {"WriteOffAmount": lambda: write_off("AllowedAmount", "PaidAmount")},
    "FactLabResults": {"DeviationFromMid": lambda: deviation_from_mid("ResultValue", "ReferenceRangeLow", "ReferenceRangeHigh")},
    "FactPrescriptions": {"TotalCost": lambda: total_cost("CostToPatient", "CostToPayer")},
    "FactFinancials": {},
}

# fact -> (staging id, natural id, date key that partitions the table, columns)
SPECS = {
    "FactClaims": ("claim_id", "ClaimID", "ServiceDateKey", _claims),
    "FactLabResults": ("lab_id", "LabID", "OrderDateKey", _labs),
    "FactPrescriptions": ("prescription_id", "PrescriptionID", "PrescribedDateKey", _prescriptions),
    "FactFinancials": ("transaction_id", "TransactionID", "TransactionDateKey", _financials),
}


def _known_dates(df: DataFrame, dim_date: DataFrame, columns: list[str]) -> DataFrame:
    """Date keys the calendar does not hold become the unknown date."""
    # the calendar has one row per day of its span
    days = F.broadcast(dim_date.select(F.col("DateKey").alias("_day")))
    for c in columns:
        df = (df.join(days, df[c] == F.col("_day"), "left")
                .withColumn(c, F.coalesce("_day", F.lit(0))).drop("_day"))
    return df


def new_fact_rows(name: str, stg: DataFrame, fact: DataFrame, dims: dict[str, DataFrame], as_of,
                  on_duplicate: str = "keep_latest", ci: bool = False, index: IdIndex | None = None) -> DataFrame:
    """The rows a load appends, without surrogate key.

    With an ``index`` of the fact table that is up to date, the table itself is not read.
    """
    staging_id, natural_id, part_key, columns = SPECS[name]
    batch = resolve_duplicates(pending_only(stg), staging_id, on_duplicate, LATEST)
    fresh = index.unseen(batch, staging_id) if index else anti_existing(batch, fact, staging_id, natural_id)
    # typed and trimmed first: the lookups below move no staging text but the ids
    cast = fresh.select(
        F.col(staging_id).alias(natural_id), *[F.col(c) for c in LOOKUPS[name]],
        *[c.alias(n) for n, c in columns().items()],
        typed_cast("created_at", "datetime").alias("CreatedAt"))
    # the patients, the largest side, come last: by then the other ids are keys and rows are short
    for id_col, (dim, dim_id, key) in sorted(LOOKUPS[name].items(), key=lambda x: x[1][0] == "DimPatient"):
        side = current_only(dims[dim]) if dim == "DimPatient" else dims[dim]
        # the code lists are of fixed length
        side = F.broadcast(side) if dim in CODE_LISTS else side
        cast = lookup_or_unknown(cast, side, id_col, dim_id, key, ci=ci).drop(id_col)
    date_keys = [c for c in cast.columns if c.endswith("DateKey")]
    known = _known_dates(cast, dims["DimDate"], date_keys).withColumn("DWLoadedAt", _instant(as_of))
    known = known.withColumns({n: c() for n, c in DERIVED[name].items()})
    return known.withColumn("PartitionYear", F.floor(F.col(part_key) / 10000).cast("int"))


def load_fact(name: str, fact: DataFrame, stg: DataFrame, dims: dict[str, DataFrame], as_of,
              on_duplicate: str = "keep_latest", ci: bool = False, index: IdIndex | None = None) -> DataFrame:
    """Rows to append to ``fact``: typed, keyed and not loaded before."""
    rows = new_fact_rows(name, stg, fact, dims, as_of, on_duplicate, ci, index)
    key = SURROGATE_KEY[name]
    return conform(one_pass_keys(rows, key, start=index.top if index else max_key(fact, key)), name)


def repeated_ids(name: str, stored: DataFrame) -> tuple[DataFrame, int]:
    """(_doubt) hashes of natural ids that a stored fact holds more than once, and their number."""
    return repeated_hashes(stored, SPECS[name][1])


def without_repeats(name: str, stored: DataFrame, doubts: DataFrame, stg: DataFrame, dims: dict[str, DataFrame], as_of) -> DataFrame:
    """``stored`` is a first load of ``stg`` with ``keep_all``: what ``keep_latest`` would have loaded.

    Rows in doubt are taken from the batch again, the others stay as they are.
    """
    staging_id, natural_id = SPECS[name][:2]
    sound = stored.join(doubts, F.xxhash64(natural_id) == F.col("_doubt"), "left_anti")
    repeated = pending_only(stg).join(doubts, F.xxhash64(staging_id) == F.col("_doubt"), "left_semi")
    rows = new_fact_rows(name, latest_of_batch(repeated, staging_id, LATEST), empty_table(stored.sparkSession, name), dims, as_of, "keep_all")
    key = SURROGATE_KEY[name]
    return sound.unionByName(conform(one_pass_keys(rows, key, start=max_key(stored, key)), name))


def fact_index(spark: SparkSession, root: str, name: str, **options) -> IdIndex:
    """The index of a fact table's natural ids under ``root``."""
    return IdIndex(spark, f"{root.rstrip('/')}/{name}", SPECS[name][1], SURROGATE_KEY[name], **options)


def load_fact_claims(fact, stg, dims, as_of, **options) -> DataFrame:
    return load_fact("FactClaims", fact, stg, dims, as_of, **options)


def load_fact_labs(fact, stg, dims, as_of, **options) -> DataFrame:
    return load_fact("FactLabResults", fact, stg, dims, as_of, **options)


def load_fact_prescriptions(fact, stg, dims, as_of, **options) -> DataFrame:
    return load_fact("FactPrescriptions", fact, stg, dims, as_of, **options)


def load_fact_financials(fact, stg, dims, as_of, **options) -> DataFrame:
    return load_fact("FactFinancials", fact, stg, dims, as_of, **options)
