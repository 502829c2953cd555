"""Schemas of the staging and warehouse tables.

Staging columns are all strings.  Warehouse types follow the data model;
surrogate keys are bigint so a table may outgrow 2^31 rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STAGING_COLUMNS = {
    "payers": ["payer_id", "payer_name", "payer_type", "plan_name", "plan_type",
               "address", "city", "state", "zip_code", "phone", "created_at"],
    "facilities": ["facility_id", "facility_name", "facility_type", "npi", "address",
                   "city", "state", "zip_code", "phone", "bed_count", "created_at"],
    "providers": ["provider_id", "npi", "first_name", "last_name", "specialty",
                  "license_number", "facility_id", "phone", "email",
                  "years_experience", "created_at"],
    "patients": ["patient_id", "first_name", "last_name", "date_of_birth", "gender",
                 "blood_type", "address", "city", "state", "zip_code", "phone",
                 "email", "primary_payer_id", "primary_provider_id", "created_at"],
    "claims": ["claim_id", "patient_id", "provider_id", "facility_id", "payer_id",
               "claim_date", "service_date", "icd10_primary", "icd10_secondary",
               "procedure_code", "billed_amount", "allowed_amount", "paid_amount",
               "claim_status", "denial_reason", "created_at"],
    "labs": ["lab_id", "patient_id", "provider_id", "facility_id", "order_date",
             "result_date", "test_name", "loinc_code", "result_value", "result_unit",
             "reference_range_low", "reference_range_high", "abnormal_flag",
             "created_at"],
    "prescriptions": ["prescription_id", "patient_id", "provider_id", "drug_name",
                      "ndc_code", "dosage", "frequency", "days_supply", "quantity",
                      "refills_authorized", "refills_remaining", "prescribed_date",
                      "fill_date", "payer_id", "cost_to_patient", "cost_to_payer",
                      "created_at"],
    "financials": ["transaction_id", "transaction_date", "transaction_type",
                   "department", "facility_id", "amount", "fiscal_year",
                   "fiscal_quarter", "cost_center", "gl_account", "description",
                   "created_at"],
}
ENTITIES = list(STAGING_COLUMNS)
NATURAL_ID = {e: cols[0] for e, cols in STAGING_COLUMNS.items()}
AUDIT_COLUMNS = ["stg_load_id", "stg_load_date", "stg_source_file", "stg_status"]

LAB_JSON_SCHEMA = (
    "lab_id string, patient_id string, order_date string, "
    "result struct<test_name:string, loinc_code:string, value:string, unit:string, "
    "reference_range:struct<low:string, high:string>, flag:string, result_date:string>"
)

TABLES = {
    "DimDate": """DateKey int, FullDate date, DayOfWeek smallint, DayName string,
        DayOfMonth smallint, DayOfYear smallint, WeekOfYear smallint,
        MonthNumber smallint, MonthName string, Quarter smallint,
        QuarterName string, Year smallint, IsWeekend boolean,
        FiscalYear smallint, FiscalQuarter smallint""",
    "DimPayer": """PayerKey bigint, PayerID string, PayerName string, PayerType string,
        PlanName string, PlanType string, Address string, City string, State string,
        ZipCode string, Phone string, CreatedAt timestamp_ntz,
        DWUpdatedAt timestamp_ntz""",
    "DimFacility": """FacilityKey bigint, FacilityID string, FacilityName string,
        FacilityType string, NPI string, Address string, City string, State string,
        ZipCode string, Phone string, BedCount smallint, CreatedAt timestamp_ntz,
        DWUpdatedAt timestamp_ntz""",
    "DimProvider": """ProviderKey bigint, ProviderID string, NPI string,
        FirstName string, LastName string, FullName string, Specialty string,
        LicenseNumber string, FacilityKey bigint, Phone string, Email string,
        YearsExperience smallint, CreatedAt timestamp_ntz,
        DWUpdatedAt timestamp_ntz""",
    "DimPatient": """PatientKey bigint, PatientID string, FirstName string,
        LastName string, FullName string, DateOfBirth date, Gender string,
        BloodType string, Address string, City string, State string, ZipCode string,
        Phone string, Email string, PrimaryPayerKey bigint,
        PrimaryProviderKey bigint, EffectiveDate date, ExpirationDate date,
        IsCurrent boolean, CreatedAt timestamp_ntz, DWUpdatedAt timestamp_ntz""",
    "DimDiagnosis": "DiagnosisKey bigint, ICD10Code string, Description string",
    "DimProcedure": """ProcedureKey bigint, CPTCode string, Description string,
        BasePrice decimal(10,2)""",
    "DimDrug": """DrugKey bigint, DrugName string, NDCCode string, Dosage string,
        Frequency string""",
    "FactClaims": """ClaimKey bigint, ClaimID string, PatientKey bigint,
        ProviderKey bigint, FacilityKey bigint, PayerKey bigint, ServiceDateKey int,
        ClaimDateKey int, DiagnosisKey bigint, ProcedureKey bigint,
        BilledAmount decimal(10,2), AllowedAmount decimal(10,2),
        PaidAmount decimal(10,2), WriteOffAmount decimal(11,2), ClaimStatus string,
        DenialReason string, CreatedAt timestamp_ntz, DWLoadedAt timestamp_ntz,
        PartitionYear int""",
    "FactLabResults": """LabKey bigint, LabID string, PatientKey bigint,
        ProviderKey bigint, FacilityKey bigint, OrderDateKey int, ResultDateKey int,
        TestName string, LOINCCode string, AbnormalFlag string,
        ResultValue decimal(10,3), ResultUnit string,
        ReferenceRangeLow decimal(10,3), ReferenceRangeHigh decimal(10,3),
        DeviationFromMid decimal(14,4), CreatedAt timestamp_ntz,
        DWLoadedAt timestamp_ntz, PartitionYear int""",
    "FactPrescriptions": """PrescriptionKey bigint, PrescriptionID string,
        PatientKey bigint, ProviderKey bigint, PayerKey bigint, DrugKey bigint,
        PrescribedDateKey int, FillDateKey int, DaysSupply smallint,
        Quantity smallint, RefillsAuthorized smallint, RefillsRemaining smallint,
        CostToPatient decimal(10,2), CostToPayer decimal(10,2),
        TotalCost decimal(11,2), CreatedAt timestamp_ntz, DWLoadedAt timestamp_ntz,
        PartitionYear int""",
    "FactFinancials": """FinancialKey bigint, TransactionID string,
        TransactionDateKey int, FacilityKey bigint, TransactionType string,
        Department string, CostCenter string, GLAccount string, Description string,
        Amount decimal(15,2), FiscalYear smallint, FiscalQuarter smallint,
        CreatedAt timestamp_ntz, DWLoadedAt timestamp_ntz, PartitionYear int""",
    "ETLLog": """LogID bigint, RunStarted timestamp_ntz, RunFinished timestamp_ntz,
        Entity string, RowsInserted bigint, RowsUpdated bigint, RowsSkipped bigint,
        Status string, ErrorMessage string""",
    "AgentUsageLog": """LogID bigint, AgentName string, SessionID string,
        InputTokens int, OutputTokens int, CachedTokens int, ToolCalls int,
        ModelID string, RequestTimestamp timestamp_ntz, Notes string""",
    "QueryCache": """CacheID bigint, CacheKey string, AgentName string, Query string,
        Response string, CreatedAt timestamp_ntz, ExpiresAt timestamp_ntz,
        Embedding array<float>""",
}

SURROGATE_KEY = {
    "DimPayer": "PayerKey", "DimFacility": "FacilityKey", "DimProvider": "ProviderKey",
    "DimPatient": "PatientKey", "FactClaims": "ClaimKey", "FactLabResults": "LabKey",
    "FactPrescriptions": "PrescriptionKey", "FactFinancials": "FinancialKey",
}
FACTS = ["FactClaims", "FactLabResults", "FactPrescriptions", "FactFinancials"]


def staging_schema(entity: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in STAGING_COLUMNS[entity]])


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the columns and types of a warehouse table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few driver-side rows as a frame whose size the optimizer knows.

    Built from Arrow it is a local relation, so joins with it are broadcast
    by its statistics and an empty one is folded away.
    """
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    data = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow), schema)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return local_rows(spark, [], TABLES[name])
