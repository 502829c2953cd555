"""Business measures.

A measure is one aggregate expression over a reporting view, so any number of
measures of a view come out of a single pass:
``evaluate(view, ["Total Billed", "Denial Rate %"], ["PayerType"])``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.predicates import slicers
from carelake.functions.scalars import TOTAL, safe_divide


def _rows() -> Column:
    return F.count(F.lit(1))


def _sum(col: str) -> Column:
    return F.coalesce(F.sum(col).cast(TOTAL), F.lit(0).cast(TOTAL))


def _sum_where(cond: Column, col: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))).cast(TOTAL), F.lit(0).cast(TOTAL))


def _pct(num: Column, den: Column) -> Column:
    return safe_divide(num, den) * 100


def _status(value: str) -> Column:
    return F.count_if(F.col("ClaimStatus") == value)


def _revenue() -> Column:
    return _sum_where(F.col("TransactionType") == "Revenue", "Amount")


def _expenses() -> Column:
    return _sum_where(F.col("TransactionType") == "Expense", "Amount")


def _abnormal() -> Column:
    # a missing flag is not Normal and counts
    return F.count_if(~F.col("AbnormalFlag").eqNullSafe("Normal"))


def _critical() -> Column:
    return F.count_if(F.col("AbnormalFlag") == "Critical")


CLAIMS, PROVIDERS, FINANCE, LABS, RX = (
    "vw_ClaimsSummary", "vw_ProviderPerformance", "vw_FinancialKPIs", "vw_LabResults", "vw_Prescriptions")

# measure -> (view, expression)
MEASURES: dict[str, tuple[str, object]] = {
    "Total Claims": (CLAIMS, _rows),
    "Total Billed": (CLAIMS, lambda: _sum("BilledAmount")),
    "Total Allowed": (CLAIMS, lambda: _sum("AllowedAmount")),
    "Total Paid": (CLAIMS, lambda: _sum("PaidAmount")),
    "Total Write-Off": (CLAIMS, lambda: _sum("WriteOffAmount")),
    "Denied Claims": (CLAIMS, lambda: _status("Denied")),
    "Denial Rate %": (CLAIMS, lambda: _pct(_status("Denied"), _rows())),
    "Approval Rate %": (CLAIMS, lambda: _pct(_status("Approved"), _rows())),
    "Avg Claim Value": (CLAIMS, lambda: safe_divide(_sum("BilledAmount"), _rows())),
    "Collection Rate %": (CLAIMS, lambda: _pct(_sum("PaidAmount"), _sum("BilledAmount"))),
    "Unique Patients": (CLAIMS, lambda: F.count_distinct("PatientID")),
    "Avg Patient Age": (CLAIMS, lambda: F.avg("PatientAgeAtService")),
    "Total Providers": (PROVIDERS, lambda: F.count_distinct("ProviderID")),
    "Provider Total Billed": (PROVIDERS, lambda: _sum("TotalBilled")),
    "Provider Total Paid": (PROVIDERS, lambda: _sum("TotalPaid")),
    "Avg Denial Rate %": (PROVIDERS, lambda: F.sum("DenialRatePct").cast("double") / F.count("DenialRatePct")),
    "Total Revenue": (FINANCE, _revenue),
    "Total Expenses": (FINANCE, _expenses),
    "Net Margin": (FINANCE, lambda: (_revenue() - _expenses()).cast(TOTAL)),
    "Net Margin %": (FINANCE, lambda: _pct(_revenue() - _expenses(), _revenue())),
    "Total Labs": (LABS, _rows),
    "Abnormal Labs": (LABS, _abnormal),
    "Abnormal Rate %": (LABS, lambda: _pct(_abnormal(), _rows())),
    "Critical Labs": (LABS, _critical),
    "Critical Rate %": (LABS, lambda: _pct(_critical(), _rows())),
    "Total Prescriptions": (RX, _rows),
    "Total Rx Cost": (RX, lambda: _sum("TotalCost")),
    "Total Patient Cost": (RX, lambda: _sum("CostToPatient")),
    "Total Payer Cost": (RX, lambda: _sum("CostToPayer")),
    "Avg Cost per Rx": (RX, lambda: safe_divide(_sum("TotalCost"), _rows())),
    "Patient Cost Share %": (RX, lambda: _pct(_sum("CostToPatient"), _sum("TotalCost"))),
    "Payer Cost Share %": (RX, lambda: _pct(_sum("CostToPayer"), _sum("TotalCost"))),
    "Write-Off Rate %": (CLAIMS, lambda: _pct(_sum("WriteOffAmount"), _sum("BilledAmount"))),
}

# Measures of the year before the one in context; see ``prior_year_measure``.
PRIOR_YEAR = {
    "Revenue PY": ("Total Revenue", False), "Revenue YoY %": ("Total Revenue", True),
    "Expenses PY": ("Total Expenses", False), "Expenses YoY %": ("Total Expenses", True),
}


def measure_expr(name: str, approximate: bool = False) -> Column:
    if approximate and name == "Unique Patients":
        return F.approx_count_distinct("PatientID")
    if approximate and name == "Total Providers":
        return F.approx_count_distinct("ProviderID")
    return MEASURES[name][1]()


def evaluate(view: DataFrame, measures: dict[str, str] | list[str], group_cols: list[str] = (),
             filters: dict | None = None, approximate: bool = False) -> DataFrame:
    """Measures of one view per group, in one aggregation.

    ``measures`` maps a measure to its output column, or lists measures to be
    returned under their own names.  No ``group_cols`` gives one total row.
    """
    names = measures if isinstance(measures, dict) else {m: m for m in measures}
    views = {MEASURES[m][0] for m in names}
    if len(views) > 1:
        raise ValueError(f"measures of different views: {sorted(views)}")
    exprs = [measure_expr(m, approximate).alias(out) for m, out in names.items()]
    return slicers(view, filters or {}).groupBy(*group_cols).agg(*exprs)


def prior_year_measure(financials: DataFrame, name: str, out: str, group_cols: list[str] = ("FiscalYear",),
                       filters: dict | None = None, keep_filters: bool = False) -> DataFrame:
    """Prior-year totals and year-over-year change.

    The context year is the latest year of each group.  By default the prior
    year is summed over the whole table: all filters and groups but the year
    are dropped.  ``keep_filters`` sums it within the same filters and groups.
    """
    base, relative = PRIOR_YEAR[name]
    view = slicers(financials, filters or {})
    keys = list(group_cols)
    now = view.groupBy(*keys).agg(measure_expr(base).alias("_now"), F.max("FiscalYear").alias("_year"))
    inside = [k for k in keys if k != "FiscalYear"] if keep_filters else []
    source = slicers(financials, {c: v for c, v in (filters or {}).items() if c != "FiscalYear"}) \
        if keep_filters else financials
    before = source.groupBy("FiscalYear", *inside).agg(measure_expr(base).alias("_py")).select(
        (F.col("FiscalYear") + 1).alias("_year"), "_py", *inside)
    joined = now.join(before, ["_year", *inside], "left")
    change = F.col("_now") - F.col("_py")
    value = safe_divide(change, "_py") * 100 if relative else F.col("_py").cast(TOTAL)
    return joined.select(*keys, value.alias(out))
