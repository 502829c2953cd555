"""The given tables read as landing data.

Deterministic expressions map customers to patients, suppliers to providers,
line items to claims and fills, events to lab results, and so on.  Money is
cast to decimal before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.scalars import abnormal_flag, paid_amount_rule
from carelake.schemas import STAGING_COLUMNS
from carelake.sources.landing import stage

CALENDAR = ("1994-01-01", "2024-12-31")
CREATED = "2024-01-01 00:00:00"
LOADED_AT = "2024-06-01 00:00:00"

# --- fixed values: lists the mapping picks from ----------------------------------
STATES = ["CA", "TX", "FL", "NY", "PA", "IL", "OH", "GA", "NC", "MI",
          "WA", "AZ", "MA", "TN", "IN", "MO", "MD", "WI", "CO", "MN"]
SPECIALTIES = [
    "Cardiology", "Internal Medicine", "Family Medicine", "Pediatrics", "Oncology", "Orthopedics",
    "Neurology", "Psychiatry", "Radiology", "Emergency Medicine", "Obstetrics & Gynecology",
    "Dermatology", "Gastroenterology", "Pulmonology", "Endocrinology", "Nephrology",
    "Infectious Disease", "Rheumatology", "Urology", "Ophthalmology"]
FACILITY_TYPES = ["Hospital", "Clinic", "Laboratory", "Pharmacy", "Urgent Care"]
DENIAL_REASONS = [
    "Service not covered", "Prior authorization required", "Duplicate claim",
    "Patient not eligible on service date", "Exceeds benefit limit", "Invalid diagnosis code"]
DEPARTMENTS = [
    "Cardiology", "Oncology", "Emergency", "Radiology", "Pharmacy", "Laboratory", "Surgery", "Pediatrics",
    "ICU", "Outpatient", "Administration", "Billing", "IT", "Nursing", "Physical Therapy"]
GL_ACCOUNTS = {"Revenue": "4000-Patient Revenue", "Expense": "5000-Salaries",
               "Reimbursement": "6000-Medicare Reimbursement", "Write-off": "7000-Bad Debt Write-off"}
PAYER_TYPES = {"FURNITURE": "Commercial", "MACHINERY": "Commercial", "BUILDING": "Medicare",
               "HOUSEHOLD": "Medicaid", "AUTOMOBILE": "Self-Pay"}
PLAN_TYPES = {"FURNITURE": "HMO", "MACHINERY": "PPO", "BUILDING": "EPO", "HOUSEHOLD": "POS", "AUTOMOBILE": "PPO"}
# event type -> (test, LOINC, unit, low, high)
LAB_TESTS = {
    "click": ("Hemoglobin", "718-7", "g/dL", "12.0", "17.5"),
    "view": ("Glucose", "2345-7", "mg/dL", "70.0", "100.0"),
    "purchase": ("Total Cholesterol", "2093-3", "mg/dL", "0.0", "200.0"),
    "signup": ("Triglycerides", "2571-8", "mg/dL", "0.0", "150.0"),
    "error": ("CRP", "1988-5", "mg/L", "0.0", "3.0"),
}
TRANSACTION_TYPES = {"1-URGENT": "Revenue", "2-HIGH": "Revenue", "3-MEDIUM": "Expense",
                     "4-NOT SPECIFIED": "Reimbursement", "5-LOW": "Write-off"}
EVENT_AGENTS = {"view": "ClaimsAgent", "click": "ClinicalAgent", "purchase": "FinancialAgent",
                "signup": "ProviderAgent", "error": "ETLAgent"}
EVENT_PRINCIPALS = {"view": "agent_claims", "click": "agent_clinical", "purchase": "agent_financial",
                    "signup": "agent_provider", "error": "agent_etl"}
AUDITED_OBJECTS = [
    "rpt.vw_ClaimsSummary", "rpt.vw_LabResults", "rpt.vw_FinancialKPIs", "dw.FactClaims", "dw.FactLabResults",
    "dw.FactPrescriptions", "dw.FactFinancials", "dw.DimPatient", "dw.DimFacility", "stg.Claims", "stg.Labs"]
STATEMENTS = {
    "view": "SELECT * FROM rpt.vw_ClaimsSummary WHERE ClaimID = {}; ;",
    "click": "SELECT 1; EXEC xp_cmdshell 'x{}'",
    "purchase": "DELETE FROM dw.FactClaims -- {} WHERE",
    "signup": "/* audit {} */ select PatientID from rpt.vw_LabResults",
    "error": "UPDATE dw.DimPatient SET City = 'x' WHERE PatientKey = {}",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for an index that is in range."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def choose(col: str, mapping: dict) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(F.col(col) == key, value) if out is None else out.when(F.col(col) == key, value)
    return out


def _id(prefix: str, col) -> Column:
    return F.concat(F.lit(prefix), (F.col(col) if isinstance(col, str) else col).cast("string"))


def _money(col: str, dtype: str = "decimal(10,2)") -> Column:
    return F.col(col).cast(dtype)


def _pad(df: DataFrame, entity: str) -> DataFrame:
    """Bring a frame to the entity's columns, missing ones NULL."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in STAGING_COLUMNS[entity]])


def payers(spark, sf_dir) -> DataFrame:
    seg = F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").select("c_mktsegment").distinct().select(
        seg.alias("payer_id"), seg.alias("payer_name"), choose("c_mktsegment", PAYER_TYPES).alias("payer_type"),
        choose("c_mktsegment", PLAN_TYPES).alias("plan_type"), F.lit(CREATED).alias("created_at"))


def facilities(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    kind = pick(FACILITY_TYPES, n % 5)
    return read(spark, sf_dir, "nation").select(
        _id("F", n).alias("facility_id"), F.col("n_name").alias("facility_name"), kind.alias("facility_type"),
        pick(STATES, n % 20).alias("state"),
        F.when(kind == "Hospital", (n + 20).cast("string")).otherwise("").alias("bed_count"),
        F.lit(CREATED).alias("created_at"))


def providers(spark, sf_dir) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        _id("P", s).alias("provider_id"), F.lit("Supplier").alias("first_name"),
        F.substring("s_name", 10, 100).alias("last_name"), pick(SPECIALTIES, s % 20).alias("specialty"),
        _id("F", "s_nationkey").alias("facility_id"), (s % 40).alias("years_experience"),
        F.lit(CREATED).alias("created_at"))


def patients(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    born = F.date_add(F.lit("1930-01-01").cast("date"), (c * 37 % 23000).cast("int"))
    gender = F.when(c % 50 == 0, "Other").when(c % 2 == 1, "M").otherwise("F")
    # one row per nation
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        _id("C", c).alias("patient_id"), F.lit("Customer").alias("first_name"),
        F.substring("c_name", 10, 100).alias("last_name"), born.alias("date_of_birth"), gender.alias("gender"),
        F.concat(c.cast("string"), F.lit(" Main St")).alias("address"), F.col("n_name").alias("city"),
        pick(STATES, F.col("c_nationkey") % 20).alias("state"),
        F.lpad((c % 100000).cast("string"), 5, "0").alias("zip_code"),
        F.col("c_mktsegment").alias("primary_payer_id"), _id("P", c % 10).alias("primary_provider_id"),
        F.lit(CREATED).alias("created_at"))


def _lines(spark, sf_dir) -> DataFrame:
    """Line items with their order and customer.  Orders meet customers first, so line items move once."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))


def _claim_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def claims(spark, sf_dir) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    status = (F.when(F.col("l_returnflag") == "A", "Approved").when(F.col("l_returnflag") == "R", "Denied")
              .when(F.col("l_linestatus") == "O", "Pending").otherwise("Appealed"))
    codes = [code for code, _ in ref.DIAGNOSES[1:]] + ["ZZZ"]
    procedures = [p[0] for p in ref.PROCEDURES[1:]] + ["ZZZZZ"]
    one = F.lit(1).cast("decimal(1,0)")
    typed = _lines(spark, sf_dir).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "*", _money("l_extendedprice").alias("billed"), status.alias("claim_status"),
        (_money("l_extendedprice") * (one - _money("l_discount", "decimal(4,2)"))).cast("decimal(10,2)")
        .alias("allowed"), (one - _money("l_tax", "decimal(4,2)")).alias("share"))
    return typed.select(
        _claim_id().alias("claim_id"), _id("C", "o_custkey").alias("patient_id"),
        _id("P", "l_suppkey").alias("provider_id"), _id("F", "s_nationkey").alias("facility_id"),
        F.col("c_mktsegment").alias("payer_id"), F.to_date("o_orderdate").alias("claim_date"),
        F.to_date("l_shipdate").alias("service_date"), pick(codes, F.col("l_partkey") % 16).alias("icd10_primary"),
        pick(procedures, F.col("l_suppkey") % 11).alias("procedure_code"), F.col("billed").alias("billed_amount"),
        F.col("allowed").alias("allowed_amount"),
        paid_amount_rule("claim_status", "allowed", "share").alias("paid_amount"), "claim_status",
        F.when(F.col("claim_status") == "Denied", pick(DENIAL_REASONS, F.col("l_linenumber") % 6)).otherwise("")
        .alias("denial_reason"), F.lit(CREATED).alias("created_at"))


def labs(spark, sf_dir) -> DataFrame:
    part = lambda i: choose("event_type", {k: v[i] for k, v in LAB_TESTS.items()})
    e = F.col("event_id")
    value, low, high = _money("value"), part(3).cast("decimal(10,1)"), part(4).cast("decimal(10,1)")
    day = F.to_date("ts")
    return read(spark, sf_dir, "events").select(
        _id("L", e).alias("lab_id"), _id("C", "user_id").alias("patient_id"), _id("P", e % 10).alias("provider_id"),
        _id("F", e % 25).alias("facility_id"), day.alias("order_date"),
        F.date_add(day, (e % 4 + 1).cast("int")).alias("result_date"), part(0).alias("test_name"),
        part(1).alias("loinc_code"), value.alias("result_value"), part(2).alias("result_unit"),
        part(3).alias("reference_range_low"), part(4).alias("reference_range_high"),
        abnormal_flag(value, low, high).alias("abnormal_flag"), F.lit(CREATED).alias("created_at"))


def prescriptions(spark, sf_dir) -> DataFrame:
    drug = lambda i: pick([d[i] for d in ref.DRUGS[1:]] + ["None"], F.col("l_partkey") % 11)
    p = F.col("l_partkey") % 12
    ordered = F.to_date("o_orderdate")
    price = _money("l_extendedprice")
    cost = lambda rate: F.round(price * F.lit(rate).cast("decimal(4,3)"), 2)
    return _lines(spark, sf_dir).select(
        F.concat(F.lit("R"), _claim_id()).alias("prescription_id"), _id("C", "o_custkey").alias("patient_id"),
        _id("P", "l_suppkey").alias("provider_id"), drug(0).alias("drug_name"), drug(1).alias("ndc_code"),
        drug(2).alias("dosage"), drug(3).alias("frequency"),
        ((F.col("l_linenumber") % 3 + 1) * 30).alias("days_supply"), F.col("l_quantity").cast("int").alias("quantity"),
        p.alias("refills_authorized"), (p - F.floor(p / 2)).alias("refills_remaining"),
        ordered.alias("prescribed_date"), F.date_add(ordered, F.col("l_linenumber") % 7).alias("fill_date"),
        F.col("c_mktsegment").alias("payer_id"), cost("0.001").alias("cost_to_patient"),
        cost("0.005").alias("cost_to_payer"), F.lit(CREATED).alias("created_at"))


def financials(spark, sf_dir) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    day = F.to_date("o_orderdate")
    typed = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn(
        "transaction_type", choose("o_orderpriority", TRANSACTION_TYPES))
    return typed.select(
        _id("T", "o_orderkey").alias("transaction_id"), day.alias("transaction_date"), "transaction_type",
        pick(DEPARTMENTS, F.col("o_custkey") % 15).alias("department"), _id("F", "c_nationkey").alias("facility_id"),
        _money("o_totalprice", "decimal(15,2)").alias("amount"), F.year(day).alias("fiscal_year"),
        F.quarter(day).alias("fiscal_quarter"), _id("CC-", F.col("o_custkey") % 900 + 100).alias("cost_center"),
        choose("transaction_type", GL_ACCOUNTS).alias("gl_account"), F.lit(CREATED).alias("created_at"))


LANDING = {"payers": payers, "facilities": facilities, "providers": providers, "patients": patients,
           "claims": claims, "labs": labs, "prescriptions": prescriptions, "financials": financials}


def landing(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """The entity's landing columns, all strings."""
    return _pad(LANDING[entity](spark, sf_dir), entity)


def staged(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    return stage(landing(spark, sf_dir, entity), entity, f"{entity}.parquet", LOADED_AT)


def second_patient_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later patient file: some payers and states differ, some ids are new."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    base = landing(spark, sf_dir, "patients").join(
        customers, F.col("patient_id") == F.concat(F.lit("C"), F.col("k").cast("string")))
    moved = base.withColumn(
        "primary_payer_id", F.when(F.col("k") % 7 == 0, F.when(F.col("primary_payer_id") == "BUILDING", "HOUSEHOLD")
                                   .otherwise("BUILDING")).otherwise(F.col("primary_payer_id"))
    ).withColumn("state", F.when(F.col("k") % 11 == 0, "ZZ").otherwise(F.col("state")))
    added = base.where(F.col("k") % 13 == 0).withColumn("patient_id", _id("N", "k"))
    return stage(moved.unionByName(added), "patients", "patients_2.parquet", "2024-06-02 00:00:00")


def usage_rows(events: DataFrame) -> DataFrame:
    """Token usage derived from events; works on streams as well."""
    v, e = F.col("value"), F.col("event_id")
    return events.select(
        (e + 1).alias("LogID"), choose("event_type", EVENT_AGENTS).alias("AgentName"),
        _id("S", "user_id").alias("SessionID"), F.floor(v * 10).cast("int").alias("InputTokens"),
        F.floor(v).cast("int").alias("OutputTokens"),
        F.when(e % 2 == 1, F.floor(v)).otherwise(0).cast("int").alias("CachedTokens"),
        (e % 5).cast("int").alias("ToolCalls"), F.lit(None).cast("string").alias("ModelID"),
        F.col("ts").cast("timestamp_ntz").alias("RequestTimestamp"), F.lit(None).cast("string").alias("Notes"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_rows(read(spark, sf_dir, "events"))


CACHE_AS_OF = "2024-01-01 00:20:00"


def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors not taken as requests, as cached answers with three lifetimes."""
    v = F.col("vec_id")
    minutes = F.when(v % 3 == 0, 15).when(v % 3 == 1, 30).otherwise(60)
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    agent, query = _id("Agent", "label"), _id("question ", "vec_id")
    return read(spark, sf_dir, "embeddings").where(v % 10 != 0).select(
        v.alias("CacheID"), F.sha2(F.concat(agent, F.lit("::"), query), 256).alias("CacheKey"),
        agent.alias("AgentName"), query.alias("Query"), _id("answer ", "vec_id").alias("Response"),
        created.alias("CreatedAt"), (created + F.make_dt_interval(mins=minutes)).alias("ExpiresAt"),
        F.col("embedding").alias("Embedding"))


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other vectors ask; their question text repeats a nearby entry's."""
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").where(v % 10 == 0).select(
        v.alias("request_id"), _id("Agent", "label").alias("AgentName"),
        F.concat(F.lit("  Question "), (v + 1 + v % 3).cast("string"), F.lit(" ")).alias("Query"), "embedding")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", choose("event_type", EVENT_PRINCIPALS).alias("principal"),
        pick(AUDITED_OBJECTS, F.col("user_id") % len(AUDITED_OBJECTS)).alias("object_name"),
        F.when(F.col("event_id") % 20 == 0, "INSERT").otherwise("SELECT").alias("permission"))


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = None
    for kind, text in STATEMENTS.items():
        head, tail = text.split("{}")
        value = F.concat(F.lit(head), F.col("event_id").cast("string"), F.lit(tail))
        sql = F.when(F.col("event_type") == kind, value) if sql is None else sql.when(
            F.col("event_type") == kind, value)
    return read(spark, sf_dir, "events").select("event_id", sql.alias("sql_text"))
