"""Measures, report datasets and year comparisons."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.plans import measures as m
from carelake.plans import reports as r
from carelake.plans.procedures import financial_margin_by_year
from carelake.plans.warehouse import warehouse_for
from carelake.registry.base import add, entry
from carelake.registry.sql import ratio, total
from carelake.registry.views import MARGINS

BLOCK = {m.CLAIMS: "v_claims", m.PROVIDERS: "v_performance", m.FINANCE: "v_fin", m.LABS: "v_labs", m.RX: "v_rx"}
GROUP = {m.CLAIMS: "PayerType", m.PROVIDERS: "Specialty", m.FINANCE: "FacilityState", m.LABS: "TestName",
         m.RX: "DrugName"}


def _total(column: str) -> str:
    return total(f'"{column}"')


def _kind(kind: str) -> str:
    return total(f'''CASE WHEN "TransactionType" = '{kind}' THEN "Amount" END''')


def _pct(num: str, den: str) -> str:
    return f"({ratio(num, den)}) * 100"


DENIED = """count(*) FILTER ("ClaimStatus" = 'Denied')"""
APPROVED = """count(*) FILTER ("ClaimStatus" = 'Approved')"""
ABNORMAL = """count(*) FILTER ("AbnormalFlag" IS DISTINCT FROM 'Normal')"""
CRITICAL = """count(*) FILTER ("AbnormalFlag" = 'Critical')"""
REVENUE, EXPENSES = _kind("Revenue"), _kind("Expense")

MEASURE_SQL = {
    "Total Claims": "count(*)", "Total Billed": _total("BilledAmount"), "Total Allowed": _total("AllowedAmount"),
    "Total Paid": _total("PaidAmount"), "Total Write-Off": _total("WriteOffAmount"), "Denied Claims": DENIED,
    "Denial Rate %": _pct(DENIED, "count(*)"), "Approval Rate %": _pct(APPROVED, "count(*)"),
    "Avg Claim Value": ratio(_total("BilledAmount"), "count(*)"),
    "Collection Rate %": _pct(_total("PaidAmount"), _total("BilledAmount")),
    "Unique Patients": 'count(DISTINCT "PatientID")',
    "Avg Patient Age": 'CAST(sum("PatientAgeAtService") AS DOUBLE) / count("PatientAgeAtService")',
    "Total Providers": 'count(DISTINCT "ProviderID")', "Provider Total Billed": _total("TotalBilled"),
    "Provider Total Paid": _total("TotalPaid"),
    "Avg Denial Rate %": 'CAST(sum("DenialRatePct") AS DOUBLE) / count("DenialRatePct")',
    "Total Revenue": REVENUE, "Total Expenses": EXPENSES,
    "Net Margin": f"CAST({REVENUE} - {EXPENSES} AS DECIMAL(38,2))",
    "Net Margin %": _pct(f"({REVENUE} - {EXPENSES})", REVENUE),
    "Total Labs": "count(*)", "Abnormal Labs": ABNORMAL, "Abnormal Rate %": _pct(ABNORMAL, "count(*)"),
    "Critical Labs": CRITICAL, "Critical Rate %": _pct(CRITICAL, "count(*)"),
    "Total Prescriptions": "count(*)", "Total Rx Cost": _total("TotalCost"),
    "Total Patient Cost": _total("CostToPatient"), "Total Payer Cost": _total("CostToPayer"),
    "Avg Cost per Rx": ratio(_total("TotalCost"), "count(*)"),
    "Patient Cost Share %": _pct(_total("CostToPatient"), _total("TotalCost")),
    "Payer Cost Share %": _pct(_total("CostToPayer"), _total("TotalCost")),
    "Write-Off Rate %": _pct(_total("WriteOffAmount"), _total("BilledAmount")),
}


def measure_key(name: str) -> str:
    words = re.sub(r"[^a-z0-9]+", "_", name.lower().replace("%", "pct")).strip("_")
    return f"m_{words}"


def _register_measure(name: str) -> None:
    view, _ = m.MEASURES[name]
    group = GROUP[view]
    add(measure_key(name),
        lambda spark, sf: m.evaluate(warehouse_for(spark, sf).view(view), {name: "value"}, [group]),
        f'SELECT "{group}", {MEASURE_SQL[name]} AS value FROM {BLOCK[view]} GROUP BY ALL')


for _name in m.MEASURES:
    _register_measure(_name)


def _register_prior_year(name: str) -> None:
    base, relative = m.PRIOR_YEAR[name]
    kind = REVENUE if "Revenue" in base else EXPENSES
    value = f"({ratio('now - py', 'py')}) * 100" if relative else "py"
    sql = f"""WITH per_state AS (SELECT "FacilityState", {kind} AS now, max("FiscalYear") AS y FROM v_fin
            WHERE "FiscalYear" <= {{year}} GROUP BY ALL),
        per_year AS (SELECT "FiscalYear" + 1 AS y, {kind} AS py FROM v_fin GROUP BY "FiscalYear")
        SELECT "FacilityState", {value} AS value FROM per_state LEFT JOIN per_year USING (y)"""
    years = list(range(1990, 2000))
    add(measure_key(name),
        lambda spark, sf: m.prior_year_measure(warehouse_for(spark, sf).view(m.FINANCE), name, "value",
                                               ["FacilityState"], {"FiscalYear": years}),
        sql.format(year=years[-1]))
    by_year = f"""WITH per_year AS (SELECT "FiscalYear", {kind} AS now FROM v_fin GROUP BY ALL)
        SELECT a."FiscalYear", {value.replace('now', 'a.now').replace('py', 'b.now')} AS value FROM per_year a
        LEFT JOIN per_year b ON b."FiscalYear" = a."FiscalYear" - 1"""
    add(measure_key(name) + "_by_year",
        lambda spark, sf: m.prior_year_measure(warehouse_for(spark, sf).view(m.FINANCE), name, "value"), by_year)


for _name in m.PRIOR_YEAR:
    _register_prior_year(_name)


@entry("m_revenue_yoy_pct_keep_filters", f"""WITH t AS (SELECT "FacilityState", "FiscalYear", {REVENUE} AS now
    FROM v_fin WHERE "Department" IN ('ICU', 'Surgery') GROUP BY ALL)
    SELECT a."FacilityState", a."FiscalYear", ({ratio('a.now - b.now', 'b.now')}) * 100 AS value FROM t a LEFT JOIN t b
    ON b."FacilityState" = a."FacilityState" AND b."FiscalYear" = a."FiscalYear" - 1""")
def _(spark, sf):
    return m.prior_year_measure(warehouse_for(spark, sf).view(m.FINANCE), "Revenue YoY %", "value",
                                ["FacilityState", "FiscalYear"], {"Department": ["ICU", "Surgery"]},
                                keep_filters=True)


# --- charts ------------------------------------------------------------------------------------

def _chart_sql(name: str) -> str:
    view, groups, measures, order, top_n = r.CHARTS[name]
    cols = ", ".join(f'"{g}"' for g in groups)
    values = ", ".join(f'{MEASURE_SQL[k]} AS "{out}"' for k, out in measures.items())
    by = ", ".join(f'"{o[1:]}" DESC' if o.startswith("-") else f'"{o}" NULLS FIRST' for o in order)
    limit = f" LIMIT {top_n}" if top_n else ""
    return f"SELECT {cols}, {values} FROM {BLOCK[view]} GROUP BY ALL ORDER BY {by}{limit}"


def _register_chart(name: str) -> None:
    view = r.CHARTS[name][0]
    add(name, lambda spark, sf: r.chart(warehouse_for(spark, sf).view(view), name), _chart_sql(name))


for _name in r.CHARTS:
    _register_chart(_name)


def _register_cards(page: str) -> None:
    view, measures = r.CARDS[page]
    values = ", ".join(f'{MEASURE_SQL[k]} AS "{out}"' for k, out in measures.items())
    add(f"kpi_cards_{page}", lambda spark, sf: r.kpi_cards(warehouse_for(spark, sf).view(view), page),
        f"SELECT {values} FROM {BLOCK[view]}")


for _page in r.CARDS:
    _register_cards(_page)


@entry("kpi_card_revenue_yoy", f"""WITH y AS (SELECT max("FiscalYear") AS top FROM v_fin),
    a AS (SELECT {REVENUE} AS now FROM v_fin),
    b AS (SELECT {REVENUE} AS py FROM v_fin WHERE "FiscalYear" = (SELECT top FROM y) - 1)
    SELECT ({ratio('now - py', 'py')}) * 100 AS "RevenueYoYPct" FROM a, b""")
def _(spark, sf):
    return r.revenue_yoy_card(warehouse_for(spark, sf).view(m.FINANCE))


def _band_sql(labels) -> str:
    parts = " ".join(f"WHEN \"PatientAgeAtService\" <= {limit} THEN '{label}'"
                     for limit, label in zip(ref.AGE_LIMITS, labels))
    return f"CASE WHEN \"PatientAgeAtService\" IS NULL THEN '{labels[0]}' {parts} ELSE '{labels[-1]}' END"


@entry("patients_by_age_band", f"""SELECT {_band_sql(ref.AGE_BANDS_NUMBERED)} AS "AgeBand",
    count(DISTINCT "PatientID") AS "UniquePatients" FROM v_claims GROUP BY ALL""")
def _(spark, sf):
    return r.patients_by_age_band(warehouse_for(spark, sf).view(m.CLAIMS))


@entry("provider_leaderboard", """SELECT "ProviderName", "Specialty", "TotalClaims", "TotalBilled", "TotalPaid",
    "DenialRatePct" FROM v_performance""")
def _(spark, sf):
    return r.provider_leaderboard(warehouse_for(spark, sf).view(m.PROVIDERS))


@entry("top_providers_by_billed", f"""SELECT "ProviderName", {_total('TotalBilled')} AS "TotalBilled"
    FROM v_performance GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return r.top_providers_by_billed(warehouse_for(spark, sf).view(m.PROVIDERS), n=10)


@entry("claims_by_specialty", """SELECT "Specialty", CAST(sum("TotalClaims") AS BIGINT) AS "TotalClaims"
    FROM v_performance GROUP BY ALL""")
def _(spark, sf):
    return r.claims_by_specialty(warehouse_for(spark, sf).view(m.PROVIDERS))


@entry("denial_vs_volume", f"""SELECT "ProviderName", CAST(sum("TotalClaims") AS BIGINT) AS "TotalClaims",
    {MEASURE_SQL['Avg Denial Rate %']} AS "AvgDenialRatePct", {_total('TotalBilled')} AS "TotalBilled"
    FROM v_performance GROUP BY ALL""")
def _(spark, sf):
    return r.denial_vs_volume(warehouse_for(spark, sf).view(m.PROVIDERS))


@entry("amount_by_type", f"""SELECT "TransactionType", {_total('Amount')} AS "Amount" FROM v_fin GROUP BY ALL""")
def _(spark, sf):
    return r.amount_by_type(warehouse_for(spark, sf).view(m.FINANCE))


@entry("top_departments", f"""SELECT "Department", {_total('Amount')} AS "Amount" FROM v_fin GROUP BY ALL
    ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return r.top_departments(warehouse_for(spark, sf).view(m.FINANCE), n=10)


@entry("cost_split_by_drug", f"""WITH t AS (SELECT "DrugName", {_total('CostToPatient')} AS "PatientCost",
    {_total('CostToPayer')} AS "PayerCost", {_total('TotalCost')} AS "TotalRxCost" FROM v_rx GROUP BY ALL
    ORDER BY 4 DESC, 1 LIMIT 10)
    SELECT *, {_pct('"PatientCost"', '("PatientCost" + "PayerCost")')} AS "PatientSharePct",
    {_pct('"PayerCost"', '("PatientCost" + "PayerCost")')} AS "PayerSharePct" FROM t""")
def _(spark, sf):
    return r.cost_split_by_drug(warehouse_for(spark, sf).view(m.RX), n=10)


@entry("date_hierarchy", """SELECT CAST(year("ServiceDate") AS INTEGER) AS "Year",
    'Qtr ' || quarter("ServiceDate") AS "Quarter", monthname("ServiceDate") AS "Month",
    CAST(day("ServiceDate") AS INTEGER) AS "Day", CAST(4 - grouping(year("ServiceDate")) - grouping('Qtr ' || quarter("ServiceDate"))
    - grouping(monthname("ServiceDate")) - grouping(day("ServiceDate")) AS INTEGER) AS "Level", count(*) AS "TotalClaims" FROM v_claims
    GROUP BY ROLLUP (year("ServiceDate"), 'Qtr ' || quarter("ServiceDate"), monthname("ServiceDate"), day("ServiceDate"))""")
def _(spark, sf):
    return r.date_hierarchy(warehouse_for(spark, sf).view(m.CLAIMS))


@entry("sliced_report_page", f"""SELECT "PayerType", {_total('BilledAmount')} AS "TotalBilled",
    {_total('PaidAmount')} AS "TotalPaid" FROM v_claims WHERE "ServiceYear" IN (1996, 1999)
    AND "ClaimStatus" IN ('Approved', 'Denied') AND "PatientState" IN ('CA', 'NY', 'OH') GROUP BY ALL""")
def _(spark, sf):
    choices = {"ServiceYear": [1996, 1999], "ClaimStatus": ["Approved", "Denied"], "PatientState": ["CA", "NY", "OH"]}
    return r.chart(warehouse_for(spark, sf).view(m.CLAIMS), "billed_vs_paid_by_payer_type", choices)


# --- year comparisons -----------------------------------------------------------------------------

@entry("prior_year", f"""WITH t AS ({MARGINS}) SELECT a."FiscalYear", a."Revenue", a."Expense",
    b."Revenue" AS "Revenue_PY", b."Expense" AS "Expense_PY" FROM t a LEFT JOIN t b
    ON b."FiscalYear" = a."FiscalYear" - 1""")
def _(spark, sf):
    yearly = financial_margin_by_year(warehouse_for(spark, sf).view(m.FINANCE))
    return r.prior_year(yearly.select("FiscalYear", "Revenue", "Expense"), "FiscalYear", ["Revenue", "Expense"])


def _delta(col: str) -> str:
    return (f'CAST(a."{col}" - b."{col}" AS DECIMAL(38,2)) AS "{col}Delta", CASE WHEN b."{col}" IS NOT NULL THEN '
            + f"({ratio(f'(a.{chr(34)}{col}{chr(34)} - b.{chr(34)}{col}{chr(34)})', f'b.{chr(34)}{col}{chr(34)}')})"
            + f' * 100 END AS "{col}DeltaPct"')


@entry("yoy_delta", f"""WITH t AS ({MARGINS}) SELECT a."FiscalYear", {_delta('Revenue')}, {_delta('Expense')}
    FROM t a LEFT JOIN t b ON b."FiscalYear" = a."FiscalYear" - 1""")
def _(spark, sf):
    yearly = financial_margin_by_year(warehouse_for(spark, sf).view(m.FINANCE))
    return r.yoy_delta(yearly, "FiscalYear", ["Revenue", "Expense"])


@entry("best_worst_margin_year", f"""WITH t AS ({MARGINS}) SELECT
    (SELECT "FiscalYear" FROM t ORDER BY "MarginPct" DESC, "FiscalYear" LIMIT 1) AS "BestYear",
    (SELECT max("MarginPct") FROM t) AS "BestValue",
    (SELECT "FiscalYear" FROM t ORDER BY "MarginPct", "FiscalYear" LIMIT 1) AS "WorstYear",
    (SELECT min("MarginPct") FROM t) AS "WorstValue" """)
def _(spark, sf):
    return r.best_worst_year(financial_margin_by_year(warehouse_for(spark, sf).view(m.FINANCE)), "FiscalYear",
                             "MarginPct")
