"""Dimension tables: calendar, static lists, type-1 upserts, type-2 history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.predicates import _instant, pending_only
from carelake.functions.scalars import blank_to_null, date_parts, full_name, typed_cast
from carelake.operators.keys import surrogate_keys
from carelake.operators.lookups import lookup_or_unknown, resolve_duplicates
from carelake.schemas import SURROGATE_KEY, TABLES, conform, local_rows, table_schema
from carelake.session import scratch_dir
from carelake.sources.tables import MOVED_ONCE, settings

DEFAULT_CALENDAR = ("2019-01-01", "2030-12-31")
LATEST = ["stg_load_date"]


# --- calendar and static lists ---------------------------------------------------

def build_dim_date(spark: SparkSession, start: str = DEFAULT_CALENDAR[0], end: str = DEFAULT_CALENDAR[1]) -> DataFrame:
    """One row per day and the unknown date with key 0."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("FullDate"))
    parts = date_parts("FullDate")
    key = F.year("FullDate") * 10000 + F.month("FullDate") * 100 + F.dayofmonth("FullDate")
    calendar = days.select(key.alias("DateKey"), "FullDate", *[c.alias(n) for n, c in parts.items()])
    return conform(calendar, "DimDate").unionByName(sentinel_rows(spark, "DimDate"))


def semantic_date_table(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar over the whole years a date column touches."""
    span = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    days = span.select(F.explode(F.sequence(
        F.make_date(F.year("lo"), F.lit(1), F.lit(1)), F.make_date(F.year("hi"), F.lit(12), F.lit(31)))).alias("Date"))
    quarter = F.quarter("Date")
    return days.select(
        "Date", F.year("Date").alias("Year"), F.month("Date").alias("MonthNo"),
        F.date_format("Date", "MMMM").alias("Month"), quarter.alias("QuarterNo"),
        F.concat(F.lit("Qtr "), quarter).alias("Quarter"), F.dayofmonth("Date").alias("Day"))


def sentinel_rows(spark: SparkSession, name: str) -> DataFrame:
    """The unknown member of a dimension."""
    known = {
        "DimDate": dict(DateKey=ref.UNKNOWN_DATE_KEY, FullDate=ref.UNKNOWN_DATE, DayName="Unknown",
                        MonthName="Unknown", QuarterName="Q0", IsWeekend=False, DayOfWeek=0, DayOfMonth=0,
                        DayOfYear=0, WeekOfYear=0, MonthNumber=0, Quarter=0, Year=0, FiscalYear=0,
                        FiscalQuarter=0),
        "DimPayer": dict(PayerKey=1, PayerID=ref.UNKNOWN_ID, PayerName="Unknown", PayerType="Unknown"),
        "DimFacility": dict(FacilityKey=1, FacilityID=ref.UNKNOWN_ID, FacilityName="Unknown",
                            FacilityType="Unknown", BedCount=0),
        "DimProvider": dict(ProviderKey=1, ProviderID=ref.UNKNOWN_ID, FirstName="Unknown", LastName="Unknown",
                            FullName="Unknown Unknown", FacilityKey=1),
        "DimPatient": dict(PatientKey=1, PatientID=ref.UNKNOWN_ID, FirstName="Unknown", LastName="Unknown",
                           FullName="Unknown Unknown", EffectiveDate=ref.UNKNOWN_DATE, IsCurrent=True),
    }[name]
    return spark.range(1).select(*[
        F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def reference_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Diagnosis, procedure and drug lists; key 1 is the unknown member."""
    rows = {
        "DimDiagnosis": [(i, *r) for i, r in enumerate(ref.DIAGNOSES, 1)],
        "DimProcedure": [(i, *r) for i, r in enumerate(ref.PROCEDURES, 1)],
        "DimDrug": [(i, *r) for i, r in enumerate(ref.DRUGS, 1)],
    }
    raw = {"DimProcedure": "ProcedureKey bigint, CPTCode string, Description string, BasePrice string"}
    return {n: conform(local_rows(spark, r, raw.get(n, TABLES[n])), n) for n, r in rows.items()}


# --- merging a batch ---------------------------------------------------------------

@dataclass(frozen=True)
class Merge:
    """What a batch does to a dimension: rows that stand, rows it closed, new rows; ``n_updated`` counts overwritten or closed ones."""

    standing: DataFrame
    closed: DataFrame
    inserted: DataFrame
    n_inserted: int
    n_updated: int

    def whole(self) -> DataFrame:
        return self.standing.unionByName(self.closed).unionByName(self.inserted)


def _row(name: str, values: dict[str, Column], state: str) -> Column:
    """A row of a warehouse table, columns without a value null, and what becomes of it."""
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name)],
                    F.lit(state).alias("_state"))


def _merge(target: DataFrame, source: DataFrame, name: str, natural_id: str, match: Column, outcome: Column) -> Merge:
    """One full outer join of ``old`` and ``new`` rows; ``outcome`` is the array of rows a pair becomes.

    The outcome is written once, apart by state, and counted on the way with the highest key,
    so target and batch are read once.  New rows get dense keys above it in the order of their id.
    """
    spark, key = target.sparkSession, SURROGATE_KEY[name]
    old, new = (df.select(F.struct(*df.columns).alias(n)) for df, n in ((target, "old"), (source, "new")))
    rows = old.join(new, match, "full").select(F.explode(outcome).alias("r")).select("r.*")
    path, seen = scratch_dir(spark, "merged"), Observation()
    state = F.col("_state")
    counted = rows.observe(seen, F.max(key).alias("top"), F.count_if(state == "new").alias("inserted"),
                           F.count_if(state.isin("updated", "closed")).alias("updated"))
    with settings(spark, MOVED_ONCE):
        counted.write.partitionBy("_state").parquet(path)
    merged = spark.read.schema(rows.schema).parquet(path)
    fresh = merged.where(state == "new").drop("_state", key)
    counts = seen.get
    return Merge(conform(merged.where(state.isin("kept", "updated")), name), conform(merged.where(state == "closed"), name),
                 conform(surrogate_keys(fresh, key, natural_id, start=counts["top"] or 0), name),
                 counts["inserted"], counts["updated"])


def _fields(df: DataFrame, side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in df.columns}


# --- type 1 ------------------------------------------------------------------------

def scd1_merge(target: DataFrame, source: DataFrame, name: str, natural_id: str, update_cols: list[str], as_of) -> Merge:
    now = {"DWUpdatedAt": _instant(as_of)}
    old, new = _fields(target, "old"), _fields(source, "new")
    outcome = (F.when(F.col("old").isNull(), F.array(_row(name, {**new, **now}, "new")))
               .when(F.col("new").isNull(), F.array(_row(name, old, "kept")))
               .otherwise(F.array(_row(name, {**old, **{c: new[c] for c in update_cols}, **now}, "updated"))))
    return _merge(target, source, name, natural_id, old[natural_id] == new[natural_id], outcome)


def scd1_upsert(target: DataFrame, source: DataFrame, name: str, natural_id: str,
                update_cols: list[str], as_of) -> DataFrame:
    """Overwrite matched rows, insert the others.

    ``source`` has warehouse column names and a unique natural id.  Matched
    rows keep their surrogate key and ``CreatedAt``.
    """
    return scd1_merge(target, source, name, natural_id, update_cols, as_of).whole()


def payer_source(stg: DataFrame) -> DataFrame:
    return stg.select(
        F.col("payer_id").alias("PayerID"), F.col("payer_name").alias("PayerName"),
        F.col("payer_type").alias("PayerType"), F.col("plan_name").alias("PlanName"),
        F.col("plan_type").alias("PlanType"), F.col("address").alias("Address"),
        F.col("city").alias("City"), F.col("state").alias("State"), F.col("zip_code").alias("ZipCode"),
        F.col("phone").alias("Phone"), typed_cast("created_at", "datetime").alias("CreatedAt"))


def facility_source(stg: DataFrame) -> DataFrame:
    return stg.select(
        F.col("facility_id").alias("FacilityID"), F.col("facility_name").alias("FacilityName"),
        F.col("facility_type").alias("FacilityType"), F.col("npi").alias("NPI"),
        F.col("address").alias("Address"), F.col("city").alias("City"), F.col("state").alias("State"),
        F.col("zip_code").alias("ZipCode"), F.col("phone").alias("Phone"),
        typed_cast(blank_to_null("bed_count"), "smallint").alias("BedCount"),
        typed_cast("created_at", "datetime").alias("CreatedAt"))


def provider_source(stg: DataFrame, dim_facility: DataFrame) -> DataFrame:
    keyed = lookup_or_unknown(stg, dim_facility, "facility_id", "FacilityID", "FacilityKey")
    return keyed.select(
        F.col("provider_id").alias("ProviderID"), F.col("npi").alias("NPI"),
        F.col("first_name").alias("FirstName"), F.col("last_name").alias("LastName"),
        full_name("first_name", "last_name").alias("FullName"), F.col("specialty").alias("Specialty"),
        F.col("license_number").alias("LicenseNumber"), "FacilityKey", F.col("phone").alias("Phone"),
        F.col("email").alias("Email"),
        typed_cast(blank_to_null("years_experience"), "tinyint").alias("YearsExperience"),
        typed_cast("created_at", "datetime").alias("CreatedAt"))


# Columns a type-1 load overwrites.
UPDATED = {
    "DimPayer": ["PayerName", "PayerType", "PlanName", "PlanType", "Address", "City", "State", "ZipCode", "Phone"],
    "DimFacility": ["FacilityName", "FacilityType", "NPI", "Address", "City", "State", "ZipCode", "Phone",
                    "BedCount"],
    "DimProvider": ["NPI", "FirstName", "LastName", "FullName", "Specialty", "LicenseNumber", "FacilityKey",
                    "Phone", "Email", "YearsExperience"],
}


def merge_dim_payer(target: DataFrame, stg: DataFrame, as_of, on_duplicate: str = "keep_latest") -> Merge:
    batch = resolve_duplicates(pending_only(stg), "payer_id", on_duplicate, LATEST)
    return scd1_merge(target, payer_source(batch), "DimPayer", "PayerID", UPDATED["DimPayer"], as_of)


def load_dim_payer(target: DataFrame, stg: DataFrame, as_of, on_duplicate: str = "keep_latest") -> DataFrame:
    return merge_dim_payer(target, stg, as_of, on_duplicate).whole()


def merge_dim_facility(target: DataFrame, stg: DataFrame, as_of, on_duplicate: str = "keep_latest") -> Merge:
    batch = resolve_duplicates(pending_only(stg), "facility_id", on_duplicate, LATEST)
    return scd1_merge(target, facility_source(batch), "DimFacility", "FacilityID", UPDATED["DimFacility"], as_of)


def load_dim_facility(target: DataFrame, stg: DataFrame, as_of, on_duplicate: str = "keep_latest") -> DataFrame:
    return merge_dim_facility(target, stg, as_of, on_duplicate).whole()


def merge_dim_provider(target: DataFrame, stg: DataFrame, dim_facility: DataFrame, as_of,
                       on_duplicate: str = "keep_latest") -> Merge:
    batch = resolve_duplicates(pending_only(stg), "provider_id", on_duplicate, LATEST)
    return scd1_merge(target, provider_source(batch, dim_facility), "DimProvider", "ProviderID", UPDATED["DimProvider"], as_of)


def load_dim_provider(target: DataFrame, stg: DataFrame, dim_facility: DataFrame, as_of,
                      on_duplicate: str = "keep_latest") -> DataFrame:
    return merge_dim_provider(target, stg, dim_facility, as_of, on_duplicate).whole()


# --- type 2 ------------------------------------------------------------------------

TRACKED = ["Address", "City", "State", "ZipCode", "PrimaryPayerKey"]


def patient_source(stg: DataFrame, dim_payer: DataFrame, dim_provider: DataFrame) -> DataFrame:
    keyed = lookup_or_unknown(stg, dim_payer, "primary_payer_id", "PayerID", "PayerKey", out="PrimaryPayerKey")
    keyed = lookup_or_unknown(keyed, dim_provider, "primary_provider_id", "ProviderID", "ProviderKey",
                              out="PrimaryProviderKey")
    return keyed.select(
        F.col("patient_id").alias("PatientID"), F.col("first_name").alias("FirstName"),
        F.col("last_name").alias("LastName"), full_name("first_name", "last_name").alias("FullName"),
        typed_cast("date_of_birth", "date").alias("DateOfBirth"), F.col("gender").alias("Gender"),
        F.col("blood_type").alias("BloodType"), F.col("address").alias("Address"), F.col("city").alias("City"),
        F.col("state").alias("State"), F.col("zip_code").alias("ZipCode"), F.col("phone").alias("Phone"),
        F.col("email").alias("Email"), "PrimaryPayerKey", "PrimaryProviderKey",
        typed_cast("created_at", "datetime").alias("CreatedAt"))


def _differs(name: str) -> Column:
    """Stored and incoming value differ, a missing value counting as blank."""
    old, new = F.col(f"old.{name}").cast("string"), F.col(f"new.{name}").cast("string")
    return F.coalesce(old, F.lit("")) != F.coalesce(new, F.lit(""))


def scd2_merge(dim: DataFrame, source: DataFrame, as_of, tracked: list[str] = TRACKED) -> Merge:
    """``dim`` may be all versions or the current ones alone; closed versions pass through untouched."""
    now = _instant(as_of)
    today = F.to_date(now)
    old, new = _fields(dim, "old"), _fields(source.withColumn("IsCurrent", F.lit(True)), "new")
    changed = F.lit(False)
    for c in tracked:
        changed = changed | _differs(c)
    closed = {**old, "ExpirationDate": F.date_sub(today, 1), "IsCurrent": F.lit(False), "DWUpdatedAt": now}
    version = _row("DimPatient", {**new, "EffectiveDate": today, "DWUpdatedAt": now}, "new")
    outcome = (F.when(F.col("old").isNull(), F.array(version))
               .when(F.col("new").isNotNull() & changed, F.array(_row("DimPatient", closed, "closed"), version))
               .otherwise(F.array(_row("DimPatient", old, "kept"))))
    # Equal in both columns, so closed versions of a patient don't meet the batch.
    match = (old["PatientID"] == new["PatientID"]) & (old["IsCurrent"] == new["IsCurrent"])
    return _merge(dim, source.withColumn("IsCurrent", F.lit(True)), "DimPatient", "PatientID", match, outcome)


def scd2_apply(dim: DataFrame, source: DataFrame, as_of, tracked: list[str] = TRACKED) -> DataFrame:
    """Expire current rows whose tracked columns changed, add new versions.

    ``source`` has warehouse column names and a unique ``PatientID``.
    Untracked columns of an unchanged patient stay as they are.
    """
    return scd2_merge(dim, source, as_of, tracked).whole()


def merge_dim_patient(dim: DataFrame, stg: DataFrame, dim_payer: DataFrame, dim_provider: DataFrame, as_of,
                      on_duplicate: str = "keep_latest") -> Merge:
    batch = resolve_duplicates(pending_only(stg), "patient_id", on_duplicate, LATEST)
    return scd2_merge(dim, patient_source(batch, dim_payer, dim_provider), as_of)


def load_dim_patient(dim: DataFrame, stg: DataFrame, dim_payer: DataFrame, dim_provider: DataFrame, as_of,
                     on_duplicate: str = "keep_latest") -> DataFrame:
    return merge_dim_patient(dim, stg, dim_payer, dim_provider, as_of, on_duplicate).whole()
