"""Report datasets: one grouped query per chart of the six report pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.predicates import slicers
from carelake.functions.scalars import TOTAL, age_band, safe_divide
from carelake.plans.measures import CLAIMS, FINANCE, LABS, PROVIDERS, RX, evaluate

# chart -> (view, group columns, measures, order, top n)
# An order entry starting with "-" sorts descending.
CHARTS: dict[str, tuple] = {
    "billed_vs_paid_by_payer_type": (CLAIMS, ["PayerType"], {"Total Billed": "TotalBilled",
                                     "Total Paid": "TotalPaid"}, ["-TotalBilled"], None),
    "claims_by_status": (CLAIMS, ["ClaimStatus"], {"Total Claims": "TotalClaims"}, ["ClaimStatus"], None),
    "claims_over_time": (CLAIMS, ["ServiceYear", "ServiceMonthNum"], {"Total Claims": "TotalClaims"},
                         ["ServiceYear", "ServiceMonthNum"], None),
    "top_denial_reasons": (CLAIMS, ["DenialReason"], {"Denied Claims": "DeniedClaims"},
                           ["-DeniedClaims", "DenialReason"], 10),
    "claims_by_patient_state": (CLAIMS, ["PatientState"], {"Total Claims": "TotalClaims"}, ["PatientState"], None),
    "gender_split": (CLAIMS, ["Gender"], {"Unique Patients": "UniquePatients"}, ["Gender"], None),
    "payer_mix": (CLAIMS, ["PayerType"], {"Unique Patients": "UniquePatients"}, ["PayerType"], None),
    "claims_by_plan_type": (CLAIMS, ["PlanType"], {"Total Claims": "TotalClaims"},
                            ["-TotalClaims", "PlanType"], None),
    "patients_by_state": (CLAIMS, ["PatientState"], {"Unique Patients": "UniquePatients"}, ["PatientState"], None),
    "revenue_vs_expense_by_year": (FINANCE, ["FiscalYear"], {"Total Revenue": "TotalRevenue",
                                   "Total Expenses": "TotalExpenses"}, ["FiscalYear"], None),
    "quarterly_trend": (FINANCE, ["FiscalYear", "FiscalQuarter"], {"Total Revenue": "TotalRevenue",
                        "Total Expenses": "TotalExpenses"}, ["FiscalYear", "FiscalQuarter"], None),
    "labs_by_test": (LABS, ["TestName"], {"Total Labs": "TotalLabs"}, ["-TotalLabs", "TestName"], None),
    "labs_by_flag": (LABS, ["AbnormalFlag"], {"Total Labs": "TotalLabs"}, ["AbnormalFlag"], None),
    "labs_over_time": (LABS, ["OrderYear", "OrderQuarter", "AbnormalFlag"], {"Total Labs": "TotalLabs"},
                       ["OrderYear", "OrderQuarter", "AbnormalFlag"], None),
    "abnormal_rate_by_test": (LABS, ["TestName"], {"Abnormal Rate %": "AbnormalRatePct"},
                              ["-AbnormalRatePct", "TestName"], None),
    "labs_by_facility": (LABS, ["FacilityName"], {"Total Labs": "TotalLabs"}, ["-TotalLabs", "FacilityName"], None),
    "top_drugs_by_volume": (RX, ["DrugName"], {"Total Prescriptions": "TotalPrescriptions"},
                            ["-TotalPrescriptions", "DrugName"], 10),
    "top_drugs_by_cost": (RX, ["DrugName"], {"Total Rx Cost": "TotalRxCost"}, ["-TotalRxCost", "DrugName"], 10),
    "rx_over_time": (RX, ["PrescribedYear", "PrescribedQuarter"], {"Total Prescriptions": "TotalPrescriptions"},
                     ["PrescribedYear", "PrescribedQuarter"], None),
    "rx_cost_by_payer_type": (RX, ["PayerType"], {"Total Rx Cost": "TotalRxCost"}, ["PayerType"], None),
}

# page -> (view, measures of its cards)
CARDS: dict[str, tuple[str, dict[str, str]]] = {
    "claims_overview": (CLAIMS, {"Total Claims": "TotalClaims", "Total Billed": "TotalBilled",
                                 "Total Paid": "TotalPaid", "Denial Rate %": "DenialRatePct"}),
    "patient_demographics": (CLAIMS, {"Unique Patients": "UniquePatients", "Avg Patient Age": "AvgPatientAge"}),
    "provider_performance": (PROVIDERS, {"Total Providers": "TotalProviders",
                                         "Avg Denial Rate %": "AvgDenialRatePct",
                                         "Provider Total Billed": "TotalBilled"}),
    "financial_kpis": (FINANCE, {"Total Revenue": "TotalRevenue", "Total Expenses": "TotalExpenses",
                                 "Net Margin": "NetMargin", "Net Margin %": "NetMarginPct"}),
    "lab_trends": (LABS, {"Total Labs": "TotalLabs", "Abnormal Rate %": "AbnormalRatePct",
                          "Critical Labs": "CriticalLabs"}),
    "prescription_analytics": (RX, {"Total Prescriptions": "TotalPrescriptions", "Total Rx Cost": "TotalRxCost",
                                    "Avg Cost per Rx": "AvgCostPerRx",
                                    "Patient Cost Share %": "PatientCostSharePct"}),
}


def _ordered(df: DataFrame, order: list[str], top_n: int | None) -> DataFrame:
    keys = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o) for o in order]
    df = df.orderBy(*keys)
    return df.limit(top_n) if top_n else df


def chart(view: DataFrame, name: str, choices: dict | None = None) -> DataFrame:
    _, groups, measures, order, top_n = CHARTS[name]
    return _ordered(evaluate(view, measures, groups, choices), order, top_n)


def kpi_cards(view: DataFrame, page: str, choices: dict | None = None) -> DataFrame:
    return evaluate(view, CARDS[page][1], filters=choices)


def revenue_yoy_card(financials: DataFrame, choices: dict | None = None) -> DataFrame:
    from carelake.plans.measures import prior_year_measure
    return prior_year_measure(financials, "Revenue YoY %", "RevenueYoYPct", [], choices)


def patients_by_age_band(claims: DataFrame, choices: dict | None = None, labels=ref.AGE_BANDS_NUMBERED) -> DataFrame:
    banded = claims.withColumn("AgeBand", age_band("PatientAgeAtService", labels))
    return evaluate(banded, {"Unique Patients": "UniquePatients"}, ["AgeBand"], choices).orderBy("AgeBand")


def provider_leaderboard(performance: DataFrame, choices: dict | None = None) -> DataFrame:
    columns = ["ProviderName", "Specialty", "TotalClaims", "TotalBilled", "TotalPaid", "DenialRatePct"]
    return slicers(performance, choices or {}).select(*columns).orderBy(F.col("TotalBilled").desc())


def top_providers_by_billed(performance: DataFrame, choices: dict | None = None, n: int | None = None) -> DataFrame:
    df = slicers(performance, choices or {}).groupBy("ProviderName").agg(
        F.sum("TotalBilled").cast(TOTAL).alias("TotalBilled"))
    return _ordered(df, ["-TotalBilled", "ProviderName"], n)


def claims_by_specialty(performance: DataFrame, choices: dict | None = None) -> DataFrame:
    df = slicers(performance, choices or {}).groupBy("Specialty").agg(F.sum("TotalClaims").alias("TotalClaims"))
    return _ordered(df, ["-TotalClaims", "Specialty"], None)


def denial_vs_volume(performance: DataFrame, choices: dict | None = None) -> DataFrame:
    """Claims, mean denial rate and billed total per provider name."""
    return slicers(performance, choices or {}).groupBy("ProviderName").agg(
        F.sum("TotalClaims").alias("TotalClaims"),
        (F.sum("DenialRatePct").cast("double") / F.count("DenialRatePct")).alias("AvgDenialRatePct"),
        F.sum("TotalBilled").cast(TOTAL).alias("TotalBilled"))


def amount_by_type(financials: DataFrame, choices: dict | None = None) -> DataFrame:
    df = slicers(financials, choices or {}).groupBy("TransactionType").agg(F.sum("Amount").cast(TOTAL).alias("Amount"))
    return _ordered(df, ["-Amount", "TransactionType"], None)


def top_departments(financials: DataFrame, choices: dict | None = None, n: int | None = None) -> DataFrame:
    df = slicers(financials, choices or {}).groupBy("Department").agg(F.sum("Amount").cast(TOTAL).alias("Amount"))
    return _ordered(df, ["-Amount", "Department"], n)


def cost_split_by_drug(prescriptions: DataFrame, choices: dict | None = None, n: int | None = None) -> DataFrame:
    df = evaluate(prescriptions, {"Total Patient Cost": "PatientCost", "Total Payer Cost": "PayerCost",
                                  "Total Rx Cost": "TotalRxCost"}, ["DrugName"], choices)
    top = _ordered(df, ["-TotalRxCost", "DrugName"], n)
    both = F.col("PatientCost") + F.col("PayerCost")
    return top.select("DrugName", "PatientCost", "PayerCost", "TotalRxCost",
                      (safe_divide("PatientCost", both) * 100).alias("PatientSharePct"),
                      (safe_divide("PayerCost", both) * 100).alias("PayerSharePct"))


def date_hierarchy(claims: DataFrame, date_col: str = "ServiceDate") -> DataFrame:
    """Claim counts drilled year, quarter, month, day.

    ``Level`` is the number of parts a line names: 0 for the grand total, 4 for
    a day.  A NULL part at or above its level is a missing date.
    Counted per day first, so the subtotals multiply days and not claims.
    """
    daily = claims.groupBy(F.col(date_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    parts = daily.select(F.year("d").alias("Year"), F.concat(F.lit("Qtr "), F.quarter("d")).alias("Quarter"),
                         F.date_format("d", "MMMM").alias("Month"), F.dayofmonth("d").alias("Day"), "n")
    names = ["Year", "Quarter", "Month", "Day"]
    level = sum((1 - F.grouping(c).cast("int") for c in names), F.lit(0)).cast("int")
    return parts.rollup(*names).agg(level.alias("Level"), F.sum("n").alias("TotalClaims"))


# --- year comparisons on already aggregated rows ---------------------------------

def prior_year(df: DataFrame, year: str, values: list[str], keys: list[str] = ()) -> DataFrame:
    """Add ``<value>_PY``: the value one year earlier, by an equi-join."""
    before = df.select((F.col(year) + 1).alias(year), *keys, *[F.col(v).alias(f"{v}_PY") for v in values])
    return df.join(before.withColumn(year, F.col(year).cast(df.schema[year].dataType)), [year, *keys], "left")


def yoy_delta(df: DataFrame, year: str, values: list[str]) -> DataFrame:
    """Absolute and relative change against the year before, where it exists.

    ``df`` holds one row per year, so the ordered window is a few rows.
    """
    w = Window.orderBy(year)
    consecutive = F.lag(year).over(w) == F.col(year) - 1
    out = [F.col(year)]
    for v in values:
        before = F.when(consecutive, F.lag(v).over(w))
        delta = F.col(v) - before
        out += [delta.cast(TOTAL).alias(f"{v}Delta"),
                F.when(before.isNotNull(), safe_divide(delta, before) * 100).alias(f"{v}DeltaPct")]
    return df.select(*out)


def best_worst_year(df: DataFrame, year: str, value: str) -> DataFrame:
    """Years with the highest and the lowest value; the earlier year wins ties."""
    rank_hi = F.struct(F.col(value), -F.col(year))
    rank_lo = F.struct(F.col(value), F.col(year))
    return df.agg(F.max_by(year, rank_hi).alias("BestYear"), F.max(value).alias("BestValue"),
                  F.min_by(year, rank_lo).alias("WorstYear"), F.min(value).alias("WorstValue"))
