"""Constraint violations and row counts, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.predicates import current_only
from carelake.schemas import SURROGATE_KEY, local_rows

# table -> columns that must not be missing
NOT_NULL = {
    "DimPayer": ["PayerKey", "PayerID", "PayerName", "PayerType"],
    "DimFacility": ["FacilityKey", "FacilityID", "FacilityName", "FacilityType"],
    "DimProvider": ["ProviderKey", "ProviderID"],
    "DimPatient": ["PatientKey", "PatientID", "EffectiveDate", "IsCurrent"],
    "FactClaims": ["ClaimKey", "ClaimID", "BilledAmount", "AllowedAmount", "PaidAmount"],
    "FactLabResults": ["LabKey", "LabID"],
    "FactPrescriptions": ["PrescriptionKey", "PrescriptionID"],
    "FactFinancials": ["FinancialKey", "TransactionID", "Amount"],
}
# table -> columns unique over the table
UNIQUE = {
    "DimPayer": ["PayerKey", "PayerID"], "DimFacility": ["FacilityKey", "FacilityID"],
    "DimProvider": ["ProviderKey", "ProviderID"], "DimPatient": ["PatientKey"],
    "FactClaims": ["ClaimKey", "ClaimID"], "FactLabResults": ["LabKey", "LabID"],
    "FactPrescriptions": ["PrescriptionKey", "PrescriptionID"], "FactFinancials": ["FinancialKey", "TransactionID"],
}
# table -> column -> (dimension, its key)
FOREIGN = {
    "DimProvider": {"FacilityKey": ("DimFacility", "FacilityKey")},
    "DimPatient": {"PrimaryPayerKey": ("DimPayer", "PayerKey"), "PrimaryProviderKey": ("DimProvider", "ProviderKey")},
    "FactClaims": {
        "PatientKey": ("DimPatient", "PatientKey"), "ProviderKey": ("DimProvider", "ProviderKey"),
        "FacilityKey": ("DimFacility", "FacilityKey"), "PayerKey": ("DimPayer", "PayerKey"),
        "ServiceDateKey": ("DimDate", "DateKey"), "ClaimDateKey": ("DimDate", "DateKey"),
        "DiagnosisKey": ("DimDiagnosis", "DiagnosisKey"), "ProcedureKey": ("DimProcedure", "ProcedureKey")},
    "FactLabResults": {
        "PatientKey": ("DimPatient", "PatientKey"), "ProviderKey": ("DimProvider", "ProviderKey"),
        "FacilityKey": ("DimFacility", "FacilityKey"), "OrderDateKey": ("DimDate", "DateKey"),
        "ResultDateKey": ("DimDate", "DateKey")},
    "FactPrescriptions": {
        "PatientKey": ("DimPatient", "PatientKey"), "ProviderKey": ("DimProvider", "ProviderKey"),
        "PayerKey": ("DimPayer", "PayerKey"), "DrugKey": ("DimDrug", "DrugKey"),
        "PrescribedDateKey": ("DimDate", "DateKey"), "FillDateKey": ("DimDate", "DateKey")},
    "FactFinancials": {"FacilityKey": ("DimFacility", "FacilityKey"), "TransactionDateKey": ("DimDate", "DateKey")},
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_violations(df: DataFrame, table: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Missing values and keys that their dimension lacks, from one pass over the table.

    Foreign keys are counted per column and key before they meet the
    dimensions, so a frequent key is one row there.
    """
    foreign = FOREIGN.get(table, {})
    cell = lambda rule, c, key: F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"), key.cast("bigint").alias("key"))
    cells = [cell("foreign_key", c, F.col(c)) for c in foreign]
    cells += [cell("not_null", c, F.when(F.col(c).isNull(), 0)) for c in NOT_NULL[table]]
    on = ["rule", "column_name", "key"]
    seen = df.select(F.inline(F.array(*cells))).where(F.col("key").isNotNull()).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    if foreign:
        known = _union([tables[d].select(F.lit("foreign_key").alias("rule"), F.lit(c).alias("column_name"),
                                         F.col(k).cast("bigint").alias("key")) for c, (d, k) in foreign.items()])
        seen = seen.join(known, on, "left_anti")
    lost = seen.groupBy("rule", "column_name").agg(F.sum("n").alias("n"))
    rules = local_rows(df.sparkSession, [("not_null", c) for c in NOT_NULL[table]] + [("foreign_key", c) for c in foreign],
                       "rule string, column_name string")
    return rules.join(lost, ["rule", "column_name"], "left").select(
        F.lit(table).alias("table_name"), "rule", "column_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))


def unique_violations(df: DataFrame, table: str, column: str, rule: str = "unique") -> DataFrame:
    """Rows beyond the first of each value."""
    extra = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), "violations")


def integrity_report(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Violations per table, rule and column; zero rows mean all is well."""
    parts = []
    for table in names or list(SURROGATE_KEY):
        df = tables[table]
        parts.append(value_violations(df, table, tables))
        parts += [unique_violations(df, table, c) for c in UNIQUE[table]]
        if table == "DimPatient":
            parts.append(unique_violations(current_only(df), table, "PatientID", "one_current_version"))
    return _union(parts)


COUNTED = ["DimPatient", "DimProvider", "FactClaims", "FactLabResults", "FactPrescriptions", "FactFinancials"]


def row_count_check(tables: dict[str, DataFrame], names: list[str] = COUNTED) -> DataFrame:
    """Rows per table, patients counting current versions only."""
    parts = []
    for name in names:
        df = current_only(tables[name]) if name == "DimPatient" else tables[name]
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"))
    return _union(parts)
