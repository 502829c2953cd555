"""Reporting views: star joins and the provider aggregate.

Each view is a function of the warehouse tables.  The calendar and the three
static lists are of fixed size and are broadcast; all other dimensions are
joined without a hint (see ``operators.lookups``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.predicates import current_only
from carelake.functions.scalars import (TOTAL, age_years, cache_hit_pct, request_date, request_hour, total_tokens)
from carelake.operators.lookups import moved, role_playing_dates

STATIC = ("DimDiagnosis", "DimProcedure", "DimDrug")


def _attributes(t: dict[str, DataFrame], dim: str, columns: dict[str, str]) -> DataFrame:
    df = t[dim].select(*[F.col(c).alias(n) for c, n in columns.items()])
    return F.broadcast(df) if dim in STATIC else df


def _dates(t: dict[str, DataFrame], key: str, columns: dict[str, str]) -> DataFrame:
    return F.broadcast(role_playing_dates(t["DimDate"], key, columns))


def _patients(t: dict[str, DataFrame], fact: DataFrame, columns: list[str], version: str) -> DataFrame:
    """Join the patient in force: before all other attributes, as this join may move the facts.

    ``surrogate`` keeps a fact only while the version it was loaded with is
    current; ``current_by_id`` follows the patient id to the current version.
    """
    current = current_only(t["DimPatient"])
    if version == "surrogate":
        return fact.join(current.select("PatientKey", *columns), "PatientKey")
    if version != "current_by_id":
        raise ValueError(f"unknown patient_version {version!r}")
    # versions meet the current one first, gathered by patient id, so facts move once and no version is sent to the driver
    rest = [c for c in columns if c != "PatientID"]
    now = F.collect_list(F.when(F.col("IsCurrent"), F.struct(*rest))).over(Window.partitionBy("PatientID"))
    followed = (t["DimPatient"].where(F.col("PatientID").isNotNull()).select("PatientKey", "PatientID", now.alias("_now"))
                .select("PatientKey", "PatientID", F.explode("_now").alias("_now")).select("PatientKey", "PatientID", "_now.*"))
    return fact.join(moved(followed, t["DimPatient"].count()), "PatientKey")


PATIENT = ["PatientID", "FullName", "Gender", "DateOfBirth", "State"]


def claims_star_join(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    fact = _patients(t, t["FactClaims"], PATIENT, patient_version)
    df = fact.join(_dates(t, "ServiceDateKey", {
        "FullDate": "ServiceDate", "Year": "ServiceYear", "Quarter": "ServiceQuarter",
        "MonthName": "ServiceMonth", "MonthNumber": "ServiceMonthNum"}), "ServiceDateKey")
    df = df.join(_dates(t, "ClaimDateKey", {"FullDate": "ClaimDate"}), "ClaimDateKey")
    df = df.join(_attributes(t, "DimDiagnosis", {
        "DiagnosisKey": "DiagnosisKey", "ICD10Code": "ICD10Code", "Description": "DiagnosisDescription"}),
        "DiagnosisKey")
    df = df.join(_attributes(t, "DimProcedure", {
        "ProcedureKey": "ProcedureKey", "CPTCode": "CPTCode", "Description": "ProcedureDescription",
        "BasePrice": "ProcedureBasePrice"}), "ProcedureKey")
    df = df.join(_attributes(t, "DimPayer", {
        "PayerKey": "PayerKey", "PayerName": "PayerName", "PayerType": "PayerType", "PlanType": "PlanType"}),
        "PayerKey")
    df = df.join(_attributes(t, "DimFacility", {
        "FacilityKey": "FacilityKey", "FacilityName": "FacilityName", "FacilityType": "FacilityType",
        "State": "FacilityState"}), "FacilityKey")
    return df.join(_attributes(t, "DimProvider", {
        "ProviderKey": "ProviderKey", "ProviderID": "ProviderID", "FullName": "ProviderName",
        "Specialty": "ProviderSpecialty"}), "ProviderKey")


def vw_claims_summary(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    return claims_star_join(t, patient_version).select(
        "ClaimID", "ClaimStatus", "DenialReason", "BilledAmount", "AllowedAmount", "PaidAmount", "WriteOffAmount",
        "ServiceDate", "ServiceYear", "ServiceQuarter", "ServiceMonth", "ServiceMonthNum", "ClaimDate",
        "PatientID", F.col("FullName").alias("PatientName"), "Gender", "DateOfBirth",
        age_years("DateOfBirth", "ServiceDate").alias("PatientAgeAtService"), F.col("State").alias("PatientState"),
        "ProviderID", "ProviderName", "ProviderSpecialty", "FacilityName", "FacilityType", "FacilityState",
        "PayerName", "PayerType", "PlanType", "ICD10Code", "DiagnosisDescription", "CPTCode",
        "ProcedureDescription", "ProcedureBasePrice")


def financial_join(t: dict[str, DataFrame]) -> DataFrame:
    df = t["FactFinancials"].join(_dates(t, "TransactionDateKey", {
        "FullDate": "TransactionDate", "MonthName": "MonthName", "MonthNumber": "MonthNumber"}),
        "TransactionDateKey")
    return df.join(_attributes(t, "DimFacility", {
        "FacilityKey": "FacilityKey", "FacilityID": "FacilityID", "FacilityName": "FacilityName",
        "FacilityType": "FacilityType", "State": "FacilityState"}), "FacilityKey")


def vw_financial_kpis(t: dict[str, DataFrame]) -> DataFrame:
    return financial_join(t).select(
        "FacilityName", "FacilityType", "FacilityState", "TransactionType", "Department", "GLAccount",
        "FiscalYear", "FiscalQuarter", "MonthName", "MonthNumber", "TransactionDate", "Amount", "CostCenter")


def labs_join(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    df = _patients(t, t["FactLabResults"], PATIENT, patient_version).join(_dates(t, "OrderDateKey", {
        "FullDate": "OrderDate", "Year": "OrderYear", "Quarter": "OrderQuarter"}), "OrderDateKey")
    df = df.join(_dates(t, "ResultDateKey", {"FullDate": "ResultDate"}), "ResultDateKey")
    df = df.join(_attributes(t, "DimFacility", {
        "FacilityKey": "FacilityKey", "FacilityName": "FacilityName", "FacilityType": "FacilityType"}),
        "FacilityKey")
    return df.join(_attributes(t, "DimProvider", {
        "ProviderKey": "ProviderKey", "FullName": "ProviderName", "Specialty": "Specialty"}), "ProviderKey")


def vw_lab_results(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    return labs_join(t, patient_version).select(
        "LabID", "TestName", "LOINCCode", "ResultValue", "ResultUnit", "ReferenceRangeLow", "ReferenceRangeHigh",
        "AbnormalFlag", "DeviationFromMid", "OrderDate", "OrderYear", "OrderQuarter", "ResultDate", "PatientID",
        F.col("FullName").alias("PatientName"), "Gender", age_years("DateOfBirth", "OrderDate").alias("PatientAge"),
        F.col("State").alias("PatientState"), "ProviderName", "Specialty", "FacilityName", "FacilityType")


def rx_join(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    df = _patients(t, t["FactPrescriptions"], PATIENT, patient_version).join(_dates(t, "PrescribedDateKey", {
        "FullDate": "PrescribedDate", "Year": "PrescribedYear", "Quarter": "PrescribedQuarter"}),
        "PrescribedDateKey")
    df = df.join(_dates(t, "FillDateKey", {"FullDate": "FillDate"}), "FillDateKey")
    df = df.join(_attributes(t, "DimDrug", {
        "DrugKey": "DrugKey", "DrugName": "DrugName", "NDCCode": "NDCCode", "Dosage": "Dosage",
        "Frequency": "Frequency"}), "DrugKey")
    df = df.join(_attributes(t, "DimPayer", {
        "PayerKey": "PayerKey", "PayerName": "PayerName", "PayerType": "PayerType", "PlanType": "PlanType"}),
        "PayerKey")
    return df.join(_attributes(t, "DimProvider", {
        "ProviderKey": "ProviderKey", "FullName": "ProviderName", "Specialty": "Specialty"}), "ProviderKey")


def vw_prescriptions(t: dict[str, DataFrame], patient_version: str = "surrogate") -> DataFrame:
    return rx_join(t, patient_version).select(
        "PrescriptionID", "DaysSupply", "Quantity", "RefillsAuthorized", "RefillsRemaining", "CostToPatient",
        "CostToPayer", "TotalCost", "PrescribedDate", "PrescribedYear", "PrescribedQuarter", "FillDate",
        "DrugName", "NDCCode", "Dosage", "Frequency", "PatientID", F.col("FullName").alias("PatientName"),
        "Gender", F.col("State").alias("PatientState"), "ProviderName", "Specialty", "PayerName", "PayerType",
        "PlanType")


PROVIDER_GROUP = ["ProviderID", "ProviderName", "Specialty", "YearsExperience", "FacilityName", "FacilityState",
                  "ServiceYear", "ServiceQuarter"]


def vw_provider_performance(t: dict[str, DataFrame]) -> DataFrame:
    """Claim figures per provider, facility, year and quarter.

    Claims are summed per surrogate key first, so the provider join sees one
    row per provider, facility and quarter instead of one per claim.
    """
    flag = lambda status: F.sum(F.when(F.col("ClaimStatus") == status, 1).otherwise(0))
    dated = t["FactClaims"].join(_dates(t, "ServiceDateKey", {
        "Year": "ServiceYear", "Quarter": "ServiceQuarter"}), "ServiceDateKey")
    summed = dated.groupBy("ProviderKey", "FacilityKey", "ServiceYear", "ServiceQuarter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("BilledAmount").alias("billed"), F.sum("PaidAmount").alias("paid"),
        flag("Denied").alias("denied"), flag("Approved").alias("approved"))
    named = summed.join(_attributes(t, "DimProvider", {
        "ProviderKey": "ProviderKey", "ProviderID": "ProviderID", "FullName": "ProviderName",
        "Specialty": "Specialty", "YearsExperience": "YearsExperience"}), "ProviderKey")
    named = named.join(_attributes(t, "DimFacility", {
        "FacilityKey": "FacilityKey", "FacilityName": "FacilityName", "State": "FacilityState"}), "FacilityKey")
    totals = named.groupBy(*PROVIDER_GROUP).agg(
        F.sum("n").alias("TotalClaims"), F.sum("billed").cast(TOTAL).alias("TotalBilled"),
        F.sum("paid").cast(TOTAL).alias("TotalPaid"), F.sum("denied").alias("DeniedClaims"),
        F.sum("approved").alias("ApprovedClaims"))
    return totals.select(
        *PROVIDER_GROUP, "TotalClaims", "TotalBilled", "TotalPaid",
        (F.col("TotalBilled").cast("double") / F.col("TotalClaims")).alias("AvgClaimValue"),
        "DeniedClaims", "ApprovedClaims",
        # percent to two places, half up, in whole numbers
        (F.expr("(DeniedClaims * 20000 + TotalClaims) div (2 * TotalClaims)").cast("decimal(12,0)") / 100)
        .cast("decimal(5,2)").alias("DenialRatePct"))


def vw_agent_usage(usage: DataFrame) -> DataFrame:
    return usage.select(
        "LogID", "AgentName", "SessionID", "InputTokens", "OutputTokens", "CachedTokens",
        total_tokens("InputTokens", "OutputTokens").alias("TotalTokens"),
        cache_hit_pct("CachedTokens", "InputTokens").alias("CacheHitPct"), "ToolCalls", "ModelID",
        "RequestTimestamp", request_date("RequestTimestamp").alias("RequestDate"),
        request_hour("RequestTimestamp").alias("RequestHour"), "Notes")


VIEWS = {
    "vw_ClaimsSummary": vw_claims_summary,
    "vw_FinancialKPIs": vw_financial_kpis,
    "vw_LabResults": vw_lab_results,
    "vw_Prescriptions": vw_prescriptions,
    "vw_ProviderPerformance": vw_provider_performance,
}
# Year column a materialised view is partitioned by.
VIEW_YEAR = {
    "vw_ClaimsSummary": "ServiceYear", "vw_FinancialKPIs": "FiscalYear", "vw_LabResults": "OrderYear",
    "vw_Prescriptions": "PrescribedYear", "vw_ProviderPerformance": "ServiceYear",
}
# Tables each view reads.
VIEW_TABLES = {
    "vw_ClaimsSummary": ["FactClaims", "DimDate", "DimPatient", "DimProvider", "DimFacility", "DimPayer",
                         "DimDiagnosis", "DimProcedure"],
    "vw_FinancialKPIs": ["FactFinancials", "DimDate", "DimFacility"],
    "vw_LabResults": ["FactLabResults", "DimDate", "DimPatient", "DimProvider", "DimFacility"],
    "vw_Prescriptions": ["FactPrescriptions", "DimDate", "DimDrug", "DimPatient", "DimProvider", "DimPayer"],
    "vw_ProviderPerformance": ["FactClaims", "DimDate", "DimProvider", "DimFacility"],
}
