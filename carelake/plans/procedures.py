"""Parameterised queries over the reporting views.

Arguments that are None add no condition.  Every top-N order ends in a
unique column, so equal leading values still give one defined result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.predicates import (abnormal_only, date_range, optional_filters, patient_filter)
from carelake.functions.scalars import TOTAL, safe_divide, timeline_detail_drug, timeline_detail_lab

CLAIM_COLUMNS = [
    "ClaimID", "ClaimStatus", "DenialReason", "BilledAmount", "AllowedAmount", "PaidAmount", "WriteOffAmount",
    "ServiceDate", "ServiceYear", "ServiceMonth", "PatientName", "PatientAgeAtService", "PatientState",
    "ProviderName", "ProviderSpecialty", "FacilityName", "PayerName", "PayerType", "ICD10Code",
    "DiagnosisDescription", "CPTCode", "ProcedureDescription"]


def _first(ordered: DataFrame, top_n: int | None) -> DataFrame:
    """All rows in order, or as many as the caller asks for."""
    return ordered if top_n is None else ordered.limit(top_n)


def _claims_where(claims: DataFrame, start_date=None, end_date=None, payer_type=None, claim_status=None,
                  state=None) -> DataFrame:
    df = date_range(claims, "ServiceDate", start_date, end_date, year_column="ServiceYear")
    return optional_filters(df, equals={"PayerType": payer_type, "ClaimStatus": claim_status, "PatientState": state})


def get_claims_summary(claims: DataFrame, start_date=None, end_date=None, payer_type=None, claim_status=None,
                       state=None, top_n: int | None = None) -> DataFrame:
    df = _claims_where(claims, start_date, end_date, payer_type, claim_status, state)
    return _first(df.select(*CLAIM_COLUMNS).orderBy(F.col("ServiceDate").desc(), "ClaimID"), top_n)


def get_financial_yoy(financials: DataFrame, start_year=None, end_year=None, facility_id=None) -> DataFrame:
    """``financials`` is the financial star join (it carries ``FacilityID``)."""
    df = optional_filters(financials, equals={"FacilityID": facility_id}, at_least={"FiscalYear": start_year},
                          at_most={"FiscalYear": end_year})
    keys = ["FiscalYear", "FiscalQuarter", "TransactionType", "FacilityName", "FacilityState"]
    total = F.sum("Amount")
    return df.groupBy(*keys).agg(
        total.cast(TOTAL).alias("TotalAmount"), F.count(F.lit(1)).alias("TransactionCount"),
        (total.cast("double") / F.count("Amount")).alias("AvgTransactionAmount"),
    ).orderBy("FiscalYear", "FiscalQuarter", "TransactionType", "FacilityName")


def get_provider_performance(performance: DataFrame, year=None, specialty=None, state=None,
                             top_n: int | None = None) -> DataFrame:
    df = optional_filters(performance, equals={"ServiceYear": year, "Specialty": specialty, "FacilityState": state})
    ordered = df.orderBy(F.col("TotalBilled").desc(), "ProviderID", "FacilityName", "ServiceYear", "ServiceQuarter")
    return _first(ordered, top_n).select(
        "ProviderName", "Specialty", "FacilityName", "FacilityState", "ServiceYear", "ServiceQuarter",
        "TotalClaims", "TotalBilled", "TotalPaid", "AvgClaimValue", "DeniedClaims", "ApprovedClaims",
        "DenialRatePct")


def _abnormal_where(labs: DataFrame, patient_id=None, start_date=None, end_date=None, flag=None) -> DataFrame:
    df = optional_filters(abnormal_only(labs), equals={"PatientID": patient_id, "AbnormalFlag": flag})
    return date_range(df, "ResultDate", start_date, end_date)


def get_abnormal_labs(labs: DataFrame, patient_id=None, start_date=None, end_date=None, flag=None,
                      top_n: int | None = None) -> DataFrame:
    df = _abnormal_where(labs, patient_id, start_date, end_date, flag)
    return _first(df.select(
        "LabID", "PatientID", "PatientName", "PatientAge", "Gender", "TestName", "LOINCCode", "ResultValue",
        "ResultUnit", "ReferenceRangeLow", "ReferenceRangeHigh", "AbnormalFlag", "DeviationFromMid",
        "ResultDate", "ProviderName", "FacilityName",
    ).orderBy(F.col("ResultDate").desc(), "LabID"), top_n)


def timeline_events(claims: DataFrame, labs: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Claims, labs and fills of all given rows as one kind of event."""
    nothing = F.lit(None).cast("decimal(11,2)")
    claim = claims.select(
        "PatientID", F.lit("Claim").alias("EventType"), F.col("ServiceDate").cast("string").alias("EventDate"),
        F.col("ClaimStatus").alias("Status"), F.col("DiagnosisDescription").alias("Detail"),
        F.col("BilledAmount").cast("decimal(11,2)").alias("Amount"), "ProviderName", "FacilityName")
    lab = labs.select(
        "PatientID", F.lit("Lab").alias("EventType"), F.col("ResultDate").cast("string").alias("EventDate"),
        F.col("AbnormalFlag").alias("Status"),
        timeline_detail_lab("TestName", "ResultValue", "ResultUnit").alias("Detail"),
        nothing.alias("Amount"), "ProviderName", "FacilityName")
    fill = prescriptions.select(
        "PatientID", F.lit("Prescription").alias("EventType"), F.col("FillDate").cast("string").alias("EventDate"),
        F.lit("Filled").alias("Status"), timeline_detail_drug("DrugName", "Dosage", "Frequency").alias("Detail"),
        F.col("TotalCost").alias("Amount"), "ProviderName", F.lit(None).cast("string").alias("FacilityName"))
    return claim.unionByName(lab).unionByName(fill)


def get_patient_timeline(claims: DataFrame, labs: DataFrame, prescriptions: DataFrame, patient_id: str,
                         start_date=None, end_date=None) -> DataFrame:
    events = timeline_events(
        patient_filter(claims, patient_id, "ServiceDate", start_date, end_date, "ServiceYear"),
        patient_filter(labs, patient_id, "ResultDate", start_date, end_date),
        patient_filter(prescriptions, patient_id, "FillDate", start_date, end_date))
    rest = [c for c in events.columns if c not in ("PatientID", "EventDate")]
    return events.drop("PatientID").orderBy(F.col("EventDate").desc(), *rest)  # equal rows may swap, others not


def claims_crosstab(claims: DataFrame, **filters) -> DataFrame:
    """Status by payer type with row, column and grand totals.

    The total lines carry ``Total`` in the column they sum over, and every
    line has its billed and paid totals and denial rate.
    """
    cells = _claims_where(claims, **filters).groupBy("ClaimStatus", "PayerType").agg(
        F.count(F.lit(1)).alias("n"), F.sum("BilledAmount").alias("billed"), F.sum("PaidAmount").alias("paid"))
    n = F.sum("n")
    denied = F.coalesce(F.sum(F.when(F.col("ClaimStatus") == "Denied", F.col("n"))), F.lit(0))
    label = lambda c: F.when(F.grouping(c) == 1, "Total").otherwise(F.col(c))
    return cells.cube("ClaimStatus", "PayerType").agg(
        label("ClaimStatus").alias("Status"), label("PayerType").alias("Payer"), n.alias("Claims"),
        F.sum("billed").cast(TOTAL).alias("TotalBilled"), F.sum("paid").cast(TOTAL).alias("TotalPaid"),
        (safe_divide(denied, n) * 100).alias("DenialRatePct"),
    ).select("Status", "Payer", "Claims", "TotalBilled", "TotalPaid", "DenialRatePct")


def financial_margin_by_year(financials: DataFrame, start_year=None, end_year=None, facility_id=None) -> DataFrame:
    df = optional_filters(financials, equals={"FacilityID": facility_id}, at_least={"FiscalYear": start_year},
                          at_most={"FiscalYear": end_year})
    zero = F.lit(0).cast(TOTAL)
    of_type = lambda kind: F.coalesce(
        F.sum(F.when(F.col("TransactionType") == kind, F.col("Amount"))).cast(TOTAL), zero)
    sums = df.groupBy("FiscalYear").agg(of_type("Revenue").alias("Revenue"), of_type("Expense").alias("Expense"))
    net = (F.col("Revenue") - F.col("Expense")).cast(TOTAL)
    return sums.select("FiscalYear", "Revenue", "Expense", net.alias("NetIncome"),
                       (safe_divide(net, "Revenue") * 100).alias("MarginPct")).orderBy("FiscalYear")


def abnormal_flag_summary(labs: DataFrame, patient_id=None, start_date=None, end_date=None, flag=None) -> DataFrame:
    df = _abnormal_where(labs, patient_id, start_date, end_date, flag)
    of_flag = lambda f: F.count_if(F.col("AbnormalFlag") == f).alias(f)
    return df.agg(of_flag("Critical"), of_flag("High"), of_flag("Low"), F.count(F.lit(1)).alias("TotalAbnormal"))


def critical_callouts(labs: DataFrame, top_n: int | None = None, **filters) -> DataFrame:
    df = _abnormal_where(labs, flag="Critical", **filters)
    return _first(df.select("LabID", "ResultDate", "PatientName", "TestName").orderBy(
        F.col("ResultDate").desc(), "LabID"), top_n)


def latest_etl_runs(log: DataFrame, n: int | None = None) -> DataFrame:
    return _first(log.orderBy(F.col("LogID").desc()), n).select(
        "LogID", "Entity", "RowsInserted", "RowsUpdated", "RowsSkipped", "Status", "ErrorMessage")


def capped(df: DataFrame, order_by: list, cap: int) -> tuple[DataFrame, DataFrame]:
    """Row count and the first ``cap`` rows, for ad-hoc results shown to people."""
    return df.agg(F.count(F.lit(1)).alias("row_count")), df.orderBy(*order_by).limit(cap)
