"""Scalar functions and filters, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions import predicates as pred
from carelake.functions import scalars as fn
from carelake.operators.dimensions import semantic_date_table
from carelake.plans.warehouse import warehouse_for
from carelake.registry.base import entry, n_rows
from carelake.registry.sql import ratio, total
from carelake.sources import testdata as td

CLAIMS, LABS = "vw_ClaimsSummary", "vw_LabResults"


@entry("typed_cast", f"""SELECT refills, days AS days_supply, count(*) AS fills, {total('patient_cost')} AS cost,
    min(prescribed) AS first_day, max(TIMESTAMP '2024-01-01 00:00:00')::DATE AS created, 0::BIGINT AS bad_numbers,
    CAST(NULL AS DATE) AS bad_date FROM s_rx GROUP BY ALL""")
def _(spark, sf):
    typed = td.staged(spark, sf, "prescriptions").select(
        fn.typed_cast("refills_authorized", "tinyint").alias("refills"),
        fn.typed_cast("days_supply", "smallint").alias("days_supply"),
        fn.typed_cast("cost_to_patient", "decimal(10,2)").alias("cost"),
        fn.typed_cast("prescribed_date", "date").alias("day"),
        fn.typed_cast("created_at", "datetime").alias("created"),
        fn.typed_cast("patient_id", "smallint").alias("bad_number"),
        fn.typed_cast("frequency", "date").alias("bad_date"))
    return typed.groupBy("refills", "days_supply").agg(
        n_rows("fills"), F.coalesce(F.sum("cost"), F.lit(0)).cast(fn.TOTAL).alias("cost"),
        F.min("day").alias("first_day"), F.max(F.to_date("created")).alias("created"),
        F.count("bad_number").alias("bad_numbers"), F.max("bad_date").alias("bad_date"))


@entry("date_key", """SELECT CASE l_linenumber % 3 WHEN 2 THEN 0 ELSE CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER)
    END AS date_key, count(*) AS lines FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    n = F.col("l_linenumber") % 3
    text = (F.when(n == 0, F.date_format("l_shipdate", "yyyyMMdd")).when(n == 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
            .otherwise("2024-02-30"))
    return td.read(spark, sf, "lineitem").groupBy(fn.date_key(text).alias("date_key")).agg(n_rows("lines"))


@entry("fn_date_key_sql", """SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n
    FROM orders GROUP BY ALL""")
def _(spark, sf):
    fn.register_sql_functions(spark)
    td.read(spark, sf, "orders").createOrReplaceTempView("carelake_orders")
    return spark.sql("""SELECT fn_DateKey(date_format(o_orderdate, 'yyyy-MM-dd')) AS date_key, count(*) AS n
                        FROM carelake_orders GROUP BY 1""")


@entry("blank_to_null", """SELECT denial_reason AS reason, count(*) AS claims FROM s_claims GROUP BY ALL""")
def _(spark, sf):
    return td.staged(spark, sf, "claims").groupBy(fn.blank_to_null("denial_reason").alias("reason")).agg(
        n_rows("claims"))


@entry("full_name", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END || ' ' || c_name
    AS full_name FROM customer""")
def _(spark, sf):
    first = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return td.read(spark, sf, "customer").select("c_custkey", fn.full_name(first, "c_name").alias("full_name"))


@entry("write_off", f"""SELECT "ClaimStatus", {total('"AllowedAmount" - "PaidAmount"')} AS write_off
    FROM v_claims GROUP BY ALL""")
def _(spark, sf):
    off = F.sum(fn.write_off("AllowedAmount", "PaidAmount")).cast(fn.TOTAL)
    return warehouse_for(spark, sf)["FactClaims"].groupBy("ClaimStatus").agg(off.alias("write_off"))


@entry("deviation_from_mid", """SELECT lab_id, CASE WHEN event_type = 'error' THEN NULL ELSE
    CAST(CAST(value AS DECIMAL(14,4)) - CAST((lo + hi) * 0.5 AS DECIMAL(14,4)) AS DECIMAL(14,4)) END AS deviation
    FROM s_labs""")
def _(spark, sf):
    low = F.when(F.col("test_name") != "CRP", F.col("reference_range_low"))
    typed = td.staged(spark, sf, "labs").select(
        "lab_id", fn.typed_cast("result_value", "decimal(10,3)").alias("v"),
        fn.typed_cast(low, "decimal(10,3)").alias("lo"),
        fn.typed_cast("reference_range_high", "decimal(10,3)").alias("hi"))
    return typed.select("lab_id", fn.deviation_from_mid("v", "lo", "hi").cast("decimal(14,4)").alias("deviation"))


@entry("total_cost", f"""SELECT payer_id, {total('patient_cost + CASE WHEN refills = 0 THEN 0 ELSE payer_cost END')}
    AS cost FROM s_rx GROUP BY ALL""")
def _(spark, sf):
    payer = F.when(F.col("refills_authorized") != "0", F.col("cost_to_payer")).cast("decimal(10,2)")
    cost = fn.total_cost(F.col("cost_to_patient").cast("decimal(10,2)"), payer)
    return td.staged(spark, sf, "prescriptions").groupBy("payer_id").agg(F.sum(cost).cast(fn.TOTAL).alias("cost"))


@entry("age_years", """SELECT "PatientAgeAtService" AS age, count(*) AS claims FROM v_claims GROUP BY ALL""")
def _(spark, sf):
    return warehouse_for(spark, sf).view(CLAIMS).groupBy(
        fn.age_years("DateOfBirth", "ServiceDate").alias("age")).agg(n_rows("claims"))


def _bands(col: str, labels) -> str:
    parts = " ".join(f"WHEN {col} <= {limit} THEN '{label}'" for limit, label in zip(ref.AGE_LIMITS, labels))
    return f"CASE WHEN {col} IS NULL THEN '{labels[0]}' {parts} ELSE '{labels[-1]}' END"


AGE = """CASE WHEN "Gender" = 'Other' THEN NULL ELSE "PatientAgeAtService" END"""


@entry("age_band", f"""SELECT {_bands('age', ref.AGE_BANDS)} AS band, {_bands('age', ref.AGE_BANDS_NUMBERED)}
    AS numbered, count(*) AS claims FROM (SELECT {AGE} AS age FROM v_claims) GROUP BY ALL""")
def _(spark, sf):
    age = F.when(F.col("Gender") != "Other", F.col("PatientAgeAtService"))
    return warehouse_for(spark, sf).view(CLAIMS).groupBy(
        fn.age_band(age).alias("band"), fn.age_band(age, ref.AGE_BANDS_NUMBERED).alias("numbered")).agg(
        n_rows("claims"))


@entry("abnormal_flag", """SELECT test, flag, count(*) AS labs FROM f_labs GROUP BY ALL""")
def _(spark, sf):
    typed = td.staged(spark, sf, "labs").select(
        F.col("test_name").alias("test"), F.col("result_value").cast("decimal(10,2)").alias("v"),
        F.col("reference_range_low").cast("decimal(10,1)").alias("lo"),
        F.col("reference_range_high").cast("decimal(10,1)").alias("hi"))
    return typed.groupBy("test", fn.abnormal_flag("v", "lo", "hi").alias("flag")).agg(n_rows("labs"))


@entry("fiscal_period", f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
    CAST((month(o_orderdate) - 1) // 3 + 1 AS INTEGER) AS fiscal_quarter, count(*) AS orders FROM orders GROUP BY ALL""")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    return td.read(spark, sf, "orders").groupBy(
        fn.fiscal_year(day).alias("fiscal_year"), fn.fiscal_quarter(day).alias("fiscal_quarter")).agg(
        n_rows("orders"))


@entry("paid_amount_rule", f"""SELECT status, {total("CASE WHEN status = 'Approved' THEN CAST(allowed * share AS DECIMAL(10,2)) ELSE 0 END")}
    AS paid FROM s_claims0 GROUP BY ALL""")
def _(spark, sf):
    one = F.lit(1).cast("decimal(1,0)")
    lines = td.read(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "Approved").when(F.col("l_returnflag") == "R", "Denied")
        .when(F.col("l_linestatus") == "O", "Pending").otherwise("Appealed").alias("status"),
        (F.col("l_extendedprice").cast("decimal(10,2)") * (one - F.col("l_discount").cast("decimal(4,2)")))
        .cast("decimal(10,2)").alias("allowed"), (one - F.col("l_tax").cast("decimal(4,2)")).alias("share"))
    return lines.groupBy("status").agg(
        F.sum(fn.paid_amount_rule("status", "allowed", "share")).cast(fn.TOTAL).alias("paid"))


DATE_PARTS = """CAST(dayofweek(d) + 1 AS SMALLINT) AS "DayOfWeek", dayname(d) AS "DayName",
    CAST(day(d) AS SMALLINT) AS "DayOfMonth", CAST(dayofyear(d) AS SMALLINT) AS "DayOfYear",
    CAST((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) // 7 + 1 AS SMALLINT) AS "WeekOfYear",
    CAST(month(d) AS SMALLINT) AS "MonthNumber", monthname(d) AS "MonthName", CAST(quarter(d) AS SMALLINT) AS "Quarter",
    'Q' || quarter(d) AS "QuarterName", CAST(year(d) AS SMALLINT) AS "Year", dayofweek(d) IN (0, 6) AS "IsWeekend",
    CAST(year(d) AS SMALLINT) AS "FiscalYear", CAST(quarter(d) AS SMALLINT) AS "FiscalQuarter" """


@entry("date_parts", f"""SELECT DISTINCT d, {DATE_PARTS} FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def _(spark, sf):
    days = td.read(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.select("d", *[c.alias(n) for n, c in fn.date_parts("d").items()])


@entry("safe_divide", f"""SELECT event_id, {ratio('value', "CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 7 END")}
    AS share FROM events""")
def _(spark, sf):
    den = F.when(F.col("event_type") != "error", F.col("event_id") % 7)
    return td.read(spark, sf, "events").select("event_id", fn.safe_divide("value", den).alias("share"))


@entry("timeline_detail", """SELECT 'lab' AS kind, "TestName" || ' = ' || CAST("ResultValue" AS VARCHAR) || ' ' || "ResultUnit"
    AS detail, count(*) AS n FROM v_labs GROUP BY ALL
    UNION ALL SELECT 'fill', "DrugName" || ' ' || "Dosage" || ' — ' || "Frequency", count(*) FROM v_rx GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    lab = wh.view(LABS).groupBy(fn.timeline_detail_lab("TestName", "ResultValue", "ResultUnit").alias("detail")).agg(
        n_rows("n")).withColumn("kind", F.lit("lab"))
    fill = wh.view("vw_Prescriptions").groupBy(
        fn.timeline_detail_drug("DrugName", "Dosage", "Frequency").alias("detail")).agg(n_rows("n")).withColumn(
        "kind", F.lit("fill"))
    return lab.unionByName(fill)


@entry("cache_hit_pct", """SELECT "LogID", CASE WHEN "InputTokens" > 0 THEN CAST("CachedTokens" AS DOUBLE)
    / "InputTokens" * 100 ELSE 0.0::DOUBLE END AS pct FROM usage""")
def _(spark, sf):
    return td.usage_log(spark, sf).select("LogID", fn.cache_hit_pct("CachedTokens", "InputTokens").alias("pct"))


@entry("request_date_hour", """SELECT CAST(ts AS DATE) AS request_date, CAST(hour(ts) AS INTEGER) AS request_hour,
    count(*) AS calls FROM events GROUP BY ALL""")
def _(spark, sf):
    return td.read(spark, sf, "events").groupBy(
        fn.request_date("ts").alias("request_date"), fn.request_hour("ts").alias("request_hour")).agg(
        n_rows("calls"))


@entry("total_tokens", """SELECT "LogID", "InputTokens" + "OutputTokens" AS tokens FROM usage""")
def _(spark, sf):
    return td.usage_log(spark, sf).select("LogID", fn.total_tokens("InputTokens", "OutputTokens").alias("tokens"))


@entry("request_key", r"""SELECT doc_id, sha256(source || '::' || lower(regexp_replace(text,
    '^[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+$', '', 'g'))) AS cache_key FROM documents""")
def _(spark, sf):
    return td.read(spark, sf, "documents").select("doc_id", fn.request_key("source", "text").alias("cache_key"))


@entry("clip_text", """SELECT doc_id, length(substr(text, 1, 2000)) AS kept, md5(substr(text, 1, 2000)) AS digest
    FROM documents""")
def _(spark, sf):
    clipped = fn.clip_text("text", 2000)
    return td.read(spark, sf, "documents").select(
        "doc_id", F.length(clipped).cast("bigint").alias("kept"), F.md5(clipped).alias("digest"))


@entry("snake_agent_name", """SELECT CASE "AgentName" WHEN 'ClaimsAgent' THEN 'claims_agent' WHEN 'ClinicalAgent'
    THEN 'clinical_agent' WHEN 'FinancialAgent' THEN 'financial_agent' WHEN 'ProviderAgent' THEN 'provider_agent'
    ELSE 'etl_agent' END AS agent, count(*) AS calls FROM usage GROUP BY ALL""")
def _(spark, sf):
    return td.usage_log(spark, sf).groupBy(fn.snake_agent_name("AgentName").alias("agent")).agg(n_rows("calls"))


@entry("cosine_unit", """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    vectors = td.read(spark, sf, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select(
        "vec_id", F.round(fn.cosine_unit("embedding", "other"), 6).alias("score"))


@entry("edi_clean", """SELECT strftime(service_date, '%Y%m%d') AS day, replace(icd, '.', '') AS icd,
    substr(provider_id, 1, 3) AS provider, count(*) AS claims FROM s_claims GROUP BY ALL""")
def _(spark, sf):
    return td.staged(spark, sf, "claims").groupBy(
        fn.edi_date("service_date").alias("day"), fn.edi_code("icd10_primary").alias("icd"),
        fn.edi_id("provider_id", 3).alias("provider")).agg(n_rows("claims"))


# --- filters --------------------------------------------------------------------------------

@entry("optional_filters", """SELECT "PayerType", count(*) AS claims FROM v_claims WHERE "ClaimStatus" = 'Pending'
    AND "ServiceDate" >= DATE '1997-01-01' AND "ServiceDate" <= DATE '2000-06-30' GROUP BY ALL""")
def _(spark, sf):
    df = pred.optional_filters(warehouse_for(spark, sf).view(CLAIMS),
                               equals={"ClaimStatus": "Pending", "PatientState": None},
                               at_least={"ServiceDate": pred.as_date("1997-01-01")},
                               at_most={"ServiceDate": pred.as_date("2000-06-30")})
    return df.groupBy("PayerType").agg(n_rows("claims"))


@entry("pending_only", """SELECT c_mktsegment AS payer_id, count(*) AS patients FROM customer WHERE c_nationkey <> 3
    GROUP BY ALL""")
def _(spark, sf):
    stg = td.staged(spark, sf, "patients").withColumn(
        "stg_status", F.when(F.col("city") == "NATION_3", "Processed").otherwise(F.col("stg_status")))
    return pred.pending_only(stg).groupBy(F.col("primary_payer_id").alias("payer_id")).agg(n_rows("patients"))


@entry("current_only", """SELECT state, count(*) AS patients FROM (SELECT state FROM d_patient
    UNION ALL SELECT NULL) GROUP BY ALL""")
def _(spark, sf):
    return pred.current_only(warehouse_for(spark, sf)["DimPatient"]).groupBy(F.col("State").alias("state")).agg(
        n_rows("patients"))


@entry("patient_filter", """SELECT "ClaimID", "ServiceDate" FROM v_claims WHERE "PatientID" = 'C10'
    AND "ServiceDate" BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'""")
def _(spark, sf):
    return pred.patient_filter(warehouse_for(spark, sf).view(CLAIMS), "C10", "ServiceDate", "1996-01-01",
                               "2001-12-31", "ServiceYear").select("ClaimID", "ServiceDate")


@entry("abnormal_only", """SELECT "AbnormalFlag", count(*) AS labs FROM v_labs WHERE "AbnormalFlag" <> 'Normal'
    AND "TestName" <> 'CRP' GROUP BY ALL""")
def _(spark, sf):
    labs = warehouse_for(spark, sf).view(LABS).withColumn(
        "AbnormalFlag", F.when(F.col("TestName") != "CRP", F.col("AbnormalFlag")))
    return pred.abnormal_only(labs).groupBy("AbnormalFlag").agg(n_rows("labs"))


@entry("unexpired", """SELECT agent AS "AgentName", count(*) AS entries FROM answers
    WHERE expires > TIMESTAMP '2024-01-01 00:20:00' GROUP BY ALL""")
def _(spark, sf):
    return pred.unexpired(td.answer_cache(spark, sf), td.CACHE_AS_OF).groupBy("AgentName").agg(n_rows("entries"))


@entry("slicers", """SELECT "FacilityName", count(*) AS labs FROM v_labs WHERE "OrderYear" IN (2024)
    AND "AbnormalFlag" IN ('High', 'Critical') AND "TestName" IN ('Glucose', 'CRP') GROUP BY ALL""")
def _(spark, sf):
    chosen = pred.slicers(warehouse_for(spark, sf).view(LABS), {
        "OrderYear": [2024], "AbnormalFlag": ["High", "Critical"], "TestName": ["Glucose", "CRP"], "Specialty": []})
    return chosen.groupBy("FacilityName").agg(n_rows("labs"))


@entry("statement_guard", r"""WITH bodies AS (SELECT event_id, upper(trim(regexp_replace(trim(regexp_replace(regexp_replace(
        sql_text, '--[^\n]*', '', 'g'), '/\*.*?\*/', '', 'gs')), ';+$', ''))) AS b FROM statements),
    found AS (SELECT event_id, list_filter([
        CASE WHEN NOT starts_with(b, 'SELECT') THEN 'not a SELECT' END,
        CASE WHEN contains(b, ';') THEN 'stacked statements' END,
        CASE WHEN regexp_matches(b, '\b(EXEC|EXECUTE|XP_\w+|SP_\w+|OPENROWSET|OPENQUERY)\b') THEN 'blocked keyword' END,
        CASE WHEN regexp_matches(b, '\b(INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP\s+TABLE|ALTER\s+TABLE|TRUNCATE\s+TABLE)\s+DW\.')
            THEN 'direct write to dw' END,
        CASE WHEN regexp_matches(b, '\bDELETE\b') AND NOT regexp_matches(b, '\bWHERE\b') THEN 'DELETE without WHERE' END
        ], lambda x: x IS NOT NULL) AS r FROM bodies)
    SELECT event_id, array_to_string(r, '; ') AS reasons, len(r) > 0 AS blocked FROM found""")
def _(spark, sf):
    return pred.statement_guard(td.statement_log(spark, sf), "sql_text").select(
        "event_id", F.concat_ws("; ", "reasons").alias("reasons"), "blocked")


@entry("semantic_date_table", """SELECT CAST(d AS DATE) AS "Date", CAST(year(d) AS INTEGER) AS "Year",
    CAST(month(d) AS INTEGER) AS "MonthNo", monthname(d) AS "Month", CAST(quarter(d) AS INTEGER) AS "QuarterNo",
    'Qtr ' || quarter(d) AS "Quarter", CAST(day(d) AS INTEGER) AS "Day" FROM (
    SELECT unnest(generate_series(make_date(CAST(year(min(o_orderdate)) AS INTEGER), 1, 1),
        make_date(CAST(year(max(o_orderdate)) AS INTEGER), 12, 31), INTERVAL 1 DAY)) AS d FROM orders)""")
def _(spark, sf):
    days = td.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return semantic_date_table(days, "d")
