"""Joins, reporting views, parameterised queries, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import predicates as pred
from carelake.functions.scalars import TOTAL
from carelake.operators import lookups, usage
from carelake.operators.dimensions import semantic_date_table
from carelake.plans import procedures as proc
from carelake.plans import views
from carelake.plans.warehouse import warehouse_for
from carelake.registry.base import add, entry, n_rows
from carelake.registry.sql import ratio, total
from carelake.sources import testdata as td

CLAIMS, FINANCE, LABS, RX, PERF = ("vw_ClaimsSummary", "vw_FinancialKPIs", "vw_LabResults", "vw_Prescriptions",
                                   "vw_ProviderPerformance")


# --- reporting views -----------------------------------------------------------------

@entry("vw_claims_summary", "SELECT * EXCLUDE (years_experience) FROM v_claims")
def _(spark, sf):
    return views.vw_claims_summary(warehouse_for(spark, sf).view_tables(CLAIMS))


@entry("vw_financial_kpis", "SELECT * EXCLUDE (facility_id) FROM v_fin")
def _(spark, sf):
    return views.vw_financial_kpis(warehouse_for(spark, sf).view_tables(FINANCE))


@entry("vw_lab_results", "SELECT * FROM v_labs")
def _(spark, sf):
    return views.vw_lab_results(warehouse_for(spark, sf).view_tables(LABS))


@entry("vw_prescriptions", "SELECT * FROM v_rx")
def _(spark, sf):
    return views.vw_prescriptions(warehouse_for(spark, sf).view_tables(RX))


@entry("vw_provider_performance", "SELECT * FROM v_performance")
def _(spark, sf):
    return views.vw_provider_performance(warehouse_for(spark, sf).view_tables(PERF))


@entry("vw_agent_usage", """SELECT "LogID", "AgentName", "SessionID", "InputTokens", "OutputTokens", "CachedTokens",
    "InputTokens" + "OutputTokens" AS "TotalTokens",
    CASE WHEN "InputTokens" > 0 THEN CAST("CachedTokens" AS DOUBLE) / "InputTokens" * 100 ELSE 0.0::DOUBLE END
        AS "CacheHitPct",
    "ToolCalls", "ModelID", CAST("RequestTimestamp" AS DATE) AS "RequestDate",
    CAST(hour("RequestTimestamp") AS INTEGER) AS "RequestHour", "Notes" FROM usage""")
def _(spark, sf):
    return views.vw_agent_usage(td.usage_log(spark, sf)).drop("RequestTimestamp")


# --- star joins, summed so every dimension takes part ---------------------------------

@entry("claims_star_join", f"""SELECT "PayerType", "FacilityState", "ICD10Code", "CPTCode", count(*) AS claims,
    {total('"BilledAmount"')} AS billed, min("ServiceDate") AS first_service, max("ClaimDate") AS last_claim,
    count(DISTINCT "PatientID") AS patients, count(DISTINCT "ProviderID") AS providers
    FROM v_claims GROUP BY ALL""")
def _(spark, sf):
    df = views.claims_star_join(warehouse_for(spark, sf).view_tables(CLAIMS))
    return df.groupBy("PayerType", "FacilityState", "ICD10Code", "CPTCode").agg(
        n_rows("claims"), F.sum("BilledAmount").cast(TOTAL).alias("billed"),
        F.min("ServiceDate").alias("first_service"), F.max("ClaimDate").alias("last_claim"),
        F.count_distinct("PatientID").alias("patients"), F.count_distinct("ProviderID").alias("providers"))


@entry("financial_join", f"""SELECT "FacilityName", "MonthName", count(*) AS transactions,
    {total('"Amount"')} AS amount FROM v_fin GROUP BY ALL""")
def _(spark, sf):
    df = views.financial_join(warehouse_for(spark, sf).view_tables(FINANCE))
    return df.groupBy("FacilityName", "MonthName").agg(
        n_rows("transactions"), F.sum("Amount").cast(TOTAL).alias("amount"))


@entry("labs_join", """SELECT "FacilityName", "Specialty", "TestName", count(*) AS labs,
    min("OrderDate") AS first_order, max("ResultDate") AS last_result FROM v_labs GROUP BY ALL""")
def _(spark, sf):
    df = views.labs_join(warehouse_for(spark, sf).view_tables(LABS))
    return df.groupBy("FacilityName", "Specialty", "TestName").agg(
        n_rows("labs"), F.min("OrderDate").alias("first_order"), F.max("ResultDate").alias("last_result"))


@entry("rx_join", f"""SELECT "DrugName", "PayerType", "Gender", count(*) AS fills, {total('"TotalCost"')} AS cost,
    max("FillDate") AS last_fill FROM v_rx GROUP BY ALL""")
def _(spark, sf):
    df = views.rx_join(warehouse_for(spark, sf).view_tables(RX))
    return df.groupBy("DrugName", "PayerType", "Gender").agg(
        n_rows("fills"), F.sum("TotalCost").cast(TOTAL).alias("cost"), F.max("FillDate").alias("last_fill"))


@entry("role_playing_dates", """SELECT CAST(year(service_date) AS SMALLINT) AS "ServiceYear",
    CAST(year(claim_date) AS SMALLINT) AS "ClaimYear", count(*) AS claims FROM f_claims GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    service = lookups.role_playing_dates(wh["DimDate"], "ServiceDateKey", {"Year": "ServiceYear"})
    claim = lookups.role_playing_dates(wh["DimDate"], "ClaimDateKey", {"Year": "ClaimYear"})
    df = wh["FactClaims"].join(service, "ServiceDateKey").join(claim, "ClaimDateKey")
    return df.groupBy("ServiceYear", "ClaimYear").agg(n_rows("claims"))


@entry("lookup_or_unknown", """SELECT icd AS icd10_primary, d.code IS NULL AS is_unknown, count(*) AS claims
    FROM s_claims LEFT JOIN dx d ON d.code = icd GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    df = lookups.lookup_or_unknown(td.staged(spark, sf, "claims"), wh["DimDiagnosis"], "icd10_primary",
                                   "ICD10Code", "DiagnosisKey")
    return df.groupBy("icd10_primary", (F.col("DiagnosisKey") == 1).alias("is_unknown")).agg(n_rows("claims"))


@entry("lookup_ignoring_case", """SELECT lower(c_mktsegment) AS payer_id,
    lower(c_mktsegment) IN (SELECT lower(id) FROM d_payer) AS known, count(*) AS patients FROM customer GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    lower = td.staged(spark, sf, "patients").select(F.lower("primary_payer_id").alias("payer_id"))
    df = lookups.lookup_or_unknown(lower, wh["DimPayer"], "payer_id", "PayerID", "PayerKey", ci=True)
    return df.groupBy("payer_id", (F.col("PayerKey") != 1).alias("known")).agg(n_rows("patients"))


@entry("scalar_lookup", """SELECT coalesce(p.plan, 'none') AS plan, count(*) AS patients FROM d_patient d
    LEFT JOIN d_payer p ON p.id = d.payer_id GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    df = lookups.scalar_lookup(td.staged(spark, sf, "patients"), wh["DimPayer"], "primary_payer_id", "PayerID",
                               "PlanType", "plan", "none")
    return df.groupBy("plan").agg(n_rows("patients"))


@entry("anti_existing", """SELECT c_custkey FROM customer WHERE NOT EXISTS (
    SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def _(spark, sf):
    return lookups.anti_existing(td.read(spark, sf, "customer"), td.read(spark, sf, "orders"), "c_custkey",
                                 "o_custkey").select("c_custkey")


@entry("semi_existing", """SELECT c_mktsegment, count(*) AS customers FROM customer WHERE EXISTS (
    SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ALL""")
def _(spark, sf):
    df = lookups.semi_existing(td.read(spark, sf, "customer"), td.read(spark, sf, "orders"), "c_custkey", "o_custkey")
    return df.groupBy("c_mktsegment").agg(n_rows("customers"))


@entry("upsert_match", """SELECT action, count(*) AS ids FROM (
    SELECT CASE WHEN s.id IS NULL THEN 'keep' WHEN t.id IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM (SELECT DISTINCT user_id AS id FROM events) s FULL JOIN (SELECT c_custkey AS id FROM customer) t
    ON s.id = t.id) GROUP BY action""")
def _(spark, sf):
    df = lookups.upsert_match(td.read(spark, sf, "customer"), td.read(spark, sf, "events"), "c_custkey", "user_id")
    return df.groupBy("action").agg(n_rows("ids"))


@entry("cross_filter", """SELECT "TestName", count(*) AS labs FROM v_labs WHERE "PatientID" IN (
    SELECT "PatientID" FROM v_claims WHERE "ClaimStatus" = 'Denied' AND "PayerType" = 'Medicare') GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    chosen = pred.slicers(wh.view(CLAIMS), {"ClaimStatus": ["Denied"], "PayerType": ["Medicare"]})
    return lookups.cross_filter(wh.view(LABS), chosen).groupBy("TestName").agg(n_rows("labs"))


CROSSED = {  # what is kept, by which selection of the other table, counted by
    "cross_filter_claims_by_labs": (CLAIMS, "v_claims", LABS, "v_labs", {"AbnormalFlag": "Critical"}, "ClaimStatus"),
    "cross_filter_prescriptions_by_claims": (RX, "v_rx", CLAIMS, "v_claims", {"ClaimStatus": "Denied"}, "DrugName"),
    "cross_filter_claims_by_prescriptions": (CLAIMS, "v_claims", RX, "v_rx", {"DrugName": "Metformin"}, "PayerType"),
}


def _crossed(kept: str, by: str, choice: dict, group: str):
    def query(spark, sf):
        wh = warehouse_for(spark, sf)
        chosen = pred.slicers(wh.view(by), {c: [v] for c, v in choice.items()})
        return lookups.cross_filter(wh.view(kept), chosen).groupBy(group).agg(n_rows("n"))
    return query


for _name, (_kept, _kept_sql, _by, _by_sql, _choice, _group) in CROSSED.items():
    _where = " AND ".join(f""""{c}" = '{v}'""" for c, v in _choice.items())
    add(_name, _crossed(_kept, _by, _choice, _group), f"""SELECT "{_group}", count(*) AS n FROM {_kept_sql}
        WHERE "PatientID" IN (SELECT "PatientID" FROM {_by_sql} WHERE {_where}) GROUP BY ALL""")


@entry("date_part_join", """SELECT CAST(year(ts) AS INTEGER) AS "Year", monthname(ts) AS "Month",
    CAST(day(ts) AS INTEGER) AS "Day", count(*) AS calls FROM events GROUP BY ALL""")
def _(spark, sf):
    events = td.read(spark, sf, "events")
    calendar = semantic_date_table(events.select(F.to_date("ts").alias("d")), "d")
    return lookups.date_part_join(events, "ts", calendar).groupBy("Year", "Month", "Day").agg(n_rows("calls"))


@entry("patient_card", """SELECT coalesce(split_part(p.name, ' ', 1), 'Unknown') AS first_name,
    coalesce(split_part(p.name, ' ', 2), 'Patient') AS last_name,
    coalesce(CAST(p.dob AS VARCHAR), 'N/A') AS date_of_birth, count(*) AS labs
    FROM s_labs s LEFT JOIN d_patient p ON p.id = s.patient_id GROUP BY ALL""")
def _(spark, sf):
    df = lookups.patient_card(td.landing(spark, sf, "labs"), td.landing(spark, sf, "patients"))
    return df.groupBy("first_name", "last_name", "date_of_birth").agg(n_rows("labs"))


@entry("current_by_id_version", f"""SELECT "PatientState", count(*) AS claims, {total('"PaidAmount"')} AS paid
    FROM v_claims GROUP BY ALL""")
def _(spark, sf):
    df = views.vw_claims_summary(warehouse_for(spark, sf).view_tables(CLAIMS), patient_version="current_by_id")
    return df.groupBy("PatientState").agg(n_rows("claims"), F.sum("PaidAmount").cast(TOTAL).alias("paid"))


# --- parameterised queries ---------------------------------------------------------------

CLAIM_LIST = ", ".join(f'"{c}"' for c in proc.CLAIM_COLUMNS)


@entry("get_claims_summary", f"""SELECT {CLAIM_LIST} FROM v_claims
    ORDER BY "ServiceDate" DESC, "ClaimID" LIMIT 100""")
def _(spark, sf):
    return proc.get_claims_summary(warehouse_for(spark, sf).view(CLAIMS), top_n=100)


@entry("get_claims_summary_filtered", f"""SELECT {CLAIM_LIST} FROM v_claims
    WHERE "ServiceDate" BETWEEN DATE '1997-03-01' AND DATE '1999-10-31' AND "PayerType" = 'Commercial'
    AND "ClaimStatus" = 'Denied' AND "PatientState" = 'TX' ORDER BY "ServiceDate" DESC, "ClaimID" LIMIT 50""")
def _(spark, sf):
    return proc.get_claims_summary(warehouse_for(spark, sf).view(CLAIMS), "1997-03-01", "1999-10-31", "Commercial",
                                   "Denied", "TX", top_n=50)


YOY = """SELECT "FiscalYear", "FiscalQuarter", "TransactionType", "FacilityName", "FacilityState",
    CAST(sum("Amount") AS DECIMAL(38,2)) AS "TotalAmount", count(*) AS "TransactionCount",
    CAST(sum("Amount") AS DOUBLE) / count("Amount") AS "AvgTransactionAmount" FROM v_fin {} GROUP BY ALL"""


@entry("get_financial_yoy", YOY.format(""))
def _(spark, sf):
    return proc.get_financial_yoy(views.financial_join(warehouse_for(spark, sf).view_tables(FINANCE)))


@entry("get_financial_yoy_filtered", YOY.format(
    """WHERE "FiscalYear" BETWEEN 1996 AND 1998 AND facility_id = 'F3'"""))
def _(spark, sf):
    joined = views.financial_join(warehouse_for(spark, sf).view_tables(FINANCE))
    return proc.get_financial_yoy(joined, 1996, 1998, "F3")


PERFORMANCE = """SELECT "ProviderName", "Specialty", "FacilityName", "FacilityState", "ServiceYear", "ServiceQuarter",
    "TotalClaims", "TotalBilled", "TotalPaid", "AvgClaimValue", "DeniedClaims", "ApprovedClaims", "DenialRatePct"
    FROM v_performance {} ORDER BY "TotalBilled" DESC, "ProviderID", "FacilityName", "ServiceYear", "ServiceQuarter"
    LIMIT 50"""


@entry("get_provider_performance", PERFORMANCE.format(""))
def _(spark, sf):
    return proc.get_provider_performance(warehouse_for(spark, sf).view(PERF), top_n=50)


@entry("get_provider_performance_filtered", PERFORMANCE.format(
    """WHERE "ServiceYear" = 1998 AND "Specialty" = 'Oncology'"""))
def _(spark, sf):
    return proc.get_provider_performance(warehouse_for(spark, sf).view(PERF), year=1998, specialty="Oncology", top_n=50)


ABNORMAL = """SELECT "LabID", "PatientID", "PatientName", "PatientAge", "Gender", "TestName", "LOINCCode",
    "ResultValue", "ResultUnit", "ReferenceRangeLow", "ReferenceRangeHigh", "AbnormalFlag", "DeviationFromMid",
    "ResultDate", "ProviderName", "FacilityName" FROM v_labs WHERE "AbnormalFlag" <> 'Normal' {}
    ORDER BY "ResultDate" DESC, "LabID" LIMIT 200"""


@entry("get_abnormal_labs", ABNORMAL.format(""))
def _(spark, sf):
    return proc.get_abnormal_labs(warehouse_for(spark, sf).view(LABS), top_n=200)


@entry("get_abnormal_labs_filtered", ABNORMAL.format(
    """AND "AbnormalFlag" = 'Low' AND "ResultDate" BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""))
def _(spark, sf):
    span = ("2024-01-05", "2024-01-20")
    labs = warehouse_for(spark, sf).patient_rows(LABS, None, *span)
    return proc.get_abnormal_labs(labs, None, *span, flag="Low", top_n=200)


TIMELINE = """SELECT "PatientID", 'Claim' AS "EventType", CAST("ServiceDate" AS VARCHAR) AS "EventDate",
    "ClaimStatus" AS "Status", "DiagnosisDescription" AS "Detail", CAST("BilledAmount" AS DECIMAL(11,2)) AS "Amount",
    "ProviderName", "FacilityName" FROM v_claims
    UNION ALL SELECT "PatientID", 'Lab', CAST("ResultDate" AS VARCHAR), "AbnormalFlag",
    "TestName" || ' = ' || CAST("ResultValue" AS VARCHAR) || ' ' || "ResultUnit", NULL, "ProviderName", "FacilityName"
    FROM v_labs
    UNION ALL SELECT "PatientID", 'Prescription', CAST("FillDate" AS VARCHAR), 'Filled',
    "DrugName" || ' ' || "Dosage" || ' — ' || "Frequency", "TotalCost", "ProviderName", NULL FROM v_rx"""


@entry("get_patient_timeline", f"""SELECT * EXCLUDE ("PatientID") FROM ({TIMELINE}) WHERE "PatientID" = 'C8'
    AND "EventDate" >= '1996-01-01' AND "EventDate" <= '2024-01-31'""")
def _(spark, sf):
    wh, asked = warehouse_for(spark, sf), ("C8", "1996-01-01", "2024-01-31")
    return proc.get_patient_timeline(*[wh.patient_rows(v, *asked) for v in (CLAIMS, LABS, RX)], *asked)


@entry("timeline_events", f"""SELECT "EventType", "Status", substr("EventDate", 1, 4) AS year, count(*) AS events,
    count("Detail") AS details, min("Detail") AS first_detail, {total('"Amount"')} AS amount
    FROM ({TIMELINE}) GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    events = proc.timeline_events(wh.view(CLAIMS), wh.view(LABS), wh.view(RX))
    return events.groupBy("EventType", "Status", F.substring("EventDate", 1, 4).alias("year")).agg(
        n_rows("events"), F.count("Detail").alias("details"), F.min("Detail").alias("first_detail"),
        F.coalesce(F.sum("Amount"), F.lit(0)).cast(TOTAL).alias("amount"))


CROSSTAB = f"""SELECT coalesce("ClaimStatus", 'Total') AS "Status", coalesce("PayerType", 'Total') AS "Payer",
    count(*) AS "Claims", {total('"BilledAmount"')} AS "TotalBilled", {total('"PaidAmount"')} AS "TotalPaid",
    ({ratio('''count(*) FILTER ("ClaimStatus" = 'Denied')''', 'count(*)')}) * 100 AS "DenialRatePct"
    FROM v_claims {{}} GROUP BY CUBE ("ClaimStatus", "PayerType")"""


@entry("claims_crosstab", CROSSTAB.format(""))
def _(spark, sf):
    return proc.claims_crosstab(warehouse_for(spark, sf).view(CLAIMS))


@entry("claims_crosstab_filtered", CROSSTAB.format(
    """WHERE "ServiceDate" >= DATE '1998-01-01' AND "PatientState" = 'FL'"""))
def _(spark, sf):
    return proc.claims_crosstab(warehouse_for(spark, sf).view(CLAIMS), start_date="1998-01-01", state="FL")


MARGIN = f"""SELECT "FiscalYear", {total('''CASE WHEN "TransactionType" = 'Revenue' THEN "Amount" END''')} AS "Revenue",
    {total('''CASE WHEN "TransactionType" = 'Expense' THEN "Amount" END''')} AS "Expense" FROM v_fin GROUP BY ALL"""
MARGINS = f"""SELECT "FiscalYear", "Revenue", "Expense", CAST("Revenue" - "Expense" AS DECIMAL(38,2)) AS "NetIncome",
    ({ratio('"Revenue" - "Expense"', '"Revenue"')}) * 100 AS "MarginPct" FROM ({MARGIN})"""


@entry("financial_margin_by_year", MARGINS)
def _(spark, sf):
    return proc.financial_margin_by_year(warehouse_for(spark, sf).view(FINANCE))


@entry("abnormal_flag_summary", """SELECT count(*) FILTER ("AbnormalFlag" = 'Critical') AS "Critical",
    count(*) FILTER ("AbnormalFlag" = 'High') AS "High", count(*) FILTER ("AbnormalFlag" = 'Low') AS "Low",
    count(*) AS "TotalAbnormal" FROM v_labs WHERE "AbnormalFlag" <> 'Normal'""")
def _(spark, sf):
    return proc.abnormal_flag_summary(warehouse_for(spark, sf).view(LABS))


@entry("critical_callouts", """SELECT "LabID", "ResultDate", "PatientName", "TestName" FROM v_labs
    WHERE "AbnormalFlag" = 'Critical' ORDER BY "ResultDate" DESC, "LabID" LIMIT 5""")
def _(spark, sf):
    return proc.critical_callouts(warehouse_for(spark, sf).view(LABS), top_n=5)


ROLLUP = """SELECT "SessionID", "AgentName", CAST(sum("InputTokens") AS BIGINT) AS "TotalInputTokens",
    CAST(sum("OutputTokens") AS BIGINT) AS "TotalOutputTokens", CAST(sum("CachedTokens") AS BIGINT)
    AS "TotalCachedTokens", CAST(sum("InputTokens" + "OutputTokens") AS BIGINT) AS "TotalTokens",
    CAST(sum("ToolCalls") AS BIGINT) AS "TotalToolCalls", count(*) AS "CallCount",
    date_diff('second', min("RequestTimestamp"), max("RequestTimestamp")) AS "DurationSeconds"
    FROM usage {} GROUP BY ALL"""


@entry("get_agent_usage", """SELECT "LogID", "AgentName", "SessionID", "InputTokens", "OutputTokens", "CachedTokens",
    "InputTokens" + "OutputTokens" AS "TotalTokens", "ToolCalls", "ModelID", "Notes" FROM usage
    WHERE "AgentName" = 'ClaimsAgent' AND CAST("RequestTimestamp" AS DATE) BETWEEN DATE '2024-01-03'
    AND DATE '2024-01-20'""")
def _(spark, sf):
    return usage.get_agent_usage(td.usage_log(spark, sf), "ClaimsAgent", "2024-01-03", "2024-01-20").drop(
        "RequestTimestamp")


@entry("get_agent_usage_rollup", ROLLUP.format(""))
def _(spark, sf):
    return usage.get_agent_usage(td.usage_log(spark, sf), rollup=True).drop("SessionStart", "SessionEnd")


@entry("session_summary", """SELECT "SessionID", "AgentName", CAST(sum("InputTokens") AS BIGINT) AS "TotalInput",
    CAST(sum("OutputTokens") AS BIGINT) AS "TotalOutput", CAST(sum("ToolCalls") AS BIGINT) AS "TotalToolCalls",
    count(*) AS "Calls" FROM usage GROUP BY ALL""")
def _(spark, sf):
    return usage.session_summary(td.usage_log(spark, sf))


# --- ordering, limits, set operations -----------------------------------------------------

@entry("top_n_order", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
    LIMIT 25""")
def _(spark, sf):
    return td.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@entry("multi_key_sort", """SELECT "FiscalYear", "FiscalQuarter", "TransactionType", count(*) AS n FROM v_fin
    GROUP BY ALL ORDER BY 1, 2, 3""")
def _(spark, sf):
    keys = ["FiscalYear", "FiscalQuarter", "TransactionType"]
    return warehouse_for(spark, sf).view(FINANCE).groupBy(*keys).agg(n_rows("n")).orderBy(*keys)


@entry("row_cap", """SELECT "ClaimID", "BilledAmount", (SELECT count(*) FROM v_claims) AS row_count FROM v_claims
    ORDER BY "BilledAmount" DESC, "ClaimID" LIMIT 500""")
def _(spark, sf):
    df = warehouse_for(spark, sf).view(CLAIMS).select("ClaimID", "BilledAmount")
    counted, head = proc.capped(df, [F.col("BilledAmount").desc(), "ClaimID"], cap=500)
    return head.select("*", counted.scalar().alias("row_count"))


@entry("union_all", """SELECT kind, count(*) AS n, count(DISTINCT patient) AS patients FROM (
    SELECT 'claim' AS kind, patient_id AS patient FROM f_claims UNION ALL SELECT 'lab', patient_id FROM s_labs
    UNION ALL SELECT 'fill', patient_id FROM f_rx) GROUP BY kind""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    part = lambda name, view: wh.view(view).select(F.lit(name).alias("kind"), F.col("PatientID").alias("patient"))
    both = part("claim", CLAIMS).unionByName(part("lab", LABS)).unionByName(part("fill", RX))
    return both.groupBy("kind").agg(n_rows("n"), F.count_distinct("patient").alias("patients"))


@entry("select_distinct", """SELECT DISTINCT "Specialty", "FacilityState" FROM v_performance""")
def _(spark, sf):
    return warehouse_for(spark, sf).view(PERF).select("Specialty", "FacilityState").dropDuplicates()


@entry("top_n_by_measure", f"""SELECT "ICD10Code", {total('"BilledAmount"')} AS billed FROM v_claims
    GROUP BY ALL ORDER BY billed DESC, "ICD10Code" LIMIT 5""")
def _(spark, sf):
    df = pred.slicers(warehouse_for(spark, sf).view(CLAIMS), {"PayerType": []})
    return df.groupBy("ICD10Code").agg(F.sum("BilledAmount").cast(TOTAL).alias("billed")).orderBy(
        F.col("billed").desc(), "ICD10Code").limit(5)
