"""Landing files, exports, loads, usage and answer cache, search, access, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.scalars import TOTAL
from carelake.operators import access, cache, dimensions, facts, keys, profile, quality, search, usage
from carelake.plans import procedures as proc
from carelake.plans.etl import STEPS, Etl, etl_log, rows_affected
from carelake.plans.warehouse import warehouse_for
from carelake.registry.base import entry, n_rows
from carelake.registry.functions import DATE_PARTS
from carelake.registry.sql import total
from carelake.schemas import ENTITIES, FACTS, empty_table, local_rows
from carelake.session import scratch_dir
from carelake.sources import export, landing
from carelake.sources import testdata as td
from carelake.sources.staging import StagingArea, mark_processed
from carelake.sources.tables import TableStore
from carelake.streaming.landing import landing_stream
from carelake.streaming.usage import crossings, current_budgets, usage_budget_stream

RUN_DATE = "20240601"
SECOND_LOAD = "2024-06-02 00:00:00"


def _money(col: str):
    return F.coalesce(F.sum(F.col(col).cast("decimal(10,2)")), F.lit(0)).cast(TOTAL)


# --- landing files and exports -------------------------------------------------------------

@entry("read_landing_csv", f"""SELECT status AS claim_status, icd AS icd10_primary, count(*) AS claims,
    {total('billed')} AS billed, min(service_date) AS first_service FROM s_claims GROUP BY ALL""")
def _(spark, sf):
    root = scratch_dir(spark, "landing")
    td.landing(spark, sf, "claims").write.option("header", True).csv(landing.landing_path(root, "claims", RUN_DATE))
    df = landing.read_landing_csv(spark, "claims", RUN_DATE, root)
    return df.groupBy("claim_status", "icd10_primary").agg(
        n_rows("claims"), _money("billed_amount").alias("billed"),
        F.min("service_date").cast("date").alias("first_service"))


@entry("read_labs_json", f"""SELECT test AS test_name, flag AS abnormal_flag, low_text AS reference_range_low,
    count(*) AS labs, {total('value')} AS result_total FROM f_labs GROUP BY ALL""")
def _(spark, sf):
    path = scratch_dir(spark, "labs-json")
    export.export_labs_nested(td.landing(spark, sf, "labs"), path)
    df = landing.read_labs_json(spark, path, multi_line=False)
    return df.groupBy("test_name", "abnormal_flag", "reference_range_low").agg(
        n_rows("labs"), _money("result_value").alias("result_total"))


@entry("read_prescriptions_json", f"""SELECT CASE WHEN code = 'None' THEN 'None' ELSE n.drug END AS drug_name,
    count(*) AS fills, {total('patient_cost')} AS cost FROM s_rx LEFT JOIN ndc n USING (code) GROUP BY ALL""")
def _(spark, sf):
    path = scratch_dir(spark, "rx-json")
    # each file is a task's, so files need not be split to be read
    td.landing(spark, sf, "prescriptions").write.option("compression", "gzip").json(path)
    df = landing.read_prescriptions_json(spark, path, multi_line=False)
    return df.groupBy("drug_name").agg(n_rows("fills"), _money("cost_to_patient").alias("cost"))


@entry("stage", """SELECT 'labs.parquet' AS stg_source_file, 'Pending' AS stg_status, DATE '2024-06-01' AS load_date,
    count(*) AS n, count(DISTINCT lab_id) AS load_ids FROM s_labs""")
def _(spark, sf):
    return td.staged(spark, sf, "labs").groupBy(
        "stg_source_file", "stg_status", F.to_date("stg_load_date").alias("load_date")).agg(
        n_rows("n"), F.count_distinct("stg_load_id").alias("load_ids"))


@entry("write_and_read_table", f"""SELECT CAST(year(order_date) AS INTEGER) AS year, count(*) AS labs,
    {total('value')} AS result_total FROM s_labs GROUP BY ALL""")
def _(spark, sf):
    store = TableStore(spark, scratch_dir(spark, "store"))
    fact = warehouse_for(spark, sf)["FactLabResults"]
    store.write_table(fact, "dw", "FactLabResults", partition_by="PartitionYear")
    store.write_table(store.read_table("dw", "FactLabResults"), "dw", "FactLabResults", partition_by="PartitionYear")
    return store.read_table("dw", "FactLabResults").groupBy(F.col("PartitionYear").alias("year")).agg(
        n_rows("labs"), F.sum("ResultValue").cast(TOTAL).alias("result_total"))


@entry("export_labs_nested", """SELECT lab_id, patient_id, CAST(order_date AS VARCHAR) AS order_date,
    '{"test_name":"' || test || '","loinc_code":"' || loinc || '","value":"' || value || '","unit":"' || unit
    || '","reference_range":{"low":"' || low_text || '","high":"' || high_text || '"},"flag":"' || flag
    || '","result_date":"' || result_date || '"}' AS result FROM f_labs""")
def _(spark, sf):
    nested = export.export_labs_nested(td.landing(spark, sf, "labs"))
    return nested.withColumn("result", F.to_json("result"))


def _claims_with_gaps(spark, sf):
    """Claims of which some lack payer, diagnosis or a readable amount."""
    last = F.ascii(F.substring("claim_id", -1, 1))
    return td.landing(spark, sf, "claims").withColumns({
        "payer_id": F.when(last % 5 != 0, F.col("payer_id")), "icd10_primary": F.when(last % 7 != 0, F.col("icd10_primary")),
        "billed_amount": F.when(F.length("claim_id") % 4 == 0, "n/a").otherwise(F.col("billed_amount"))})


GAPS = """SELECT * REPLACE (CASE WHEN ascii(right(claim_id, 1)) % 5 <> 0 THEN payer_id END AS payer_id,
    CASE WHEN ascii(right(claim_id, 1)) % 7 <> 0 THEN icd END AS icd) FROM s_claims"""


@entry("edi_faults", f"""SELECT claim_id, array_to_string(r, '; ') AS reasons, list_contains(r, 'no billed_amount') AS refused FROM (
    SELECT claim_id, list_filter([CASE WHEN length(claim_id) % 4 = 0 THEN 'no billed_amount' END,
        CASE WHEN length(claim_id) > 20 THEN 'long claim_id' END, CASE WHEN length(patient_id) > 12 THEN 'long patient_id' END,
        CASE WHEN length(provider_id) > 10 THEN 'long provider_id' END, CASE WHEN length(payer_id) > 9 THEN 'long payer_id' END],
        lambda x: x IS NOT NULL) AS r FROM ({GAPS})) WHERE len(r) > 0""")
def _(spark, sf):
    return export.edi_faults(_claims_with_gaps(spark, sf)).withColumn("reasons", F.array_join("reasons", "; "))


@entry("export_edi_837", f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY claim_id) - 1 AS pos FROM ({GAPS}) WHERE length(claim_id) % 4 <> 0),
    n AS (SELECT *, pos // 1000 + 1 AS batch, pos % 1000 + 1 AS no, printf('%04d', pos % 1000 + 1) AS st,
        strftime(service_date, '%Y%m%d') AS sd, strftime(claim_date, '%Y%m%d') AS cd FROM c),
    s AS (SELECT batch, unnest(['ST*837*' || st || '*005010X222A1~',
        'BHT*0019*00*' || st || '*' || cd || '*1200*CH~',
        'NM1*41*2*CARELAKE*****46*' || printf('%010d', no) || '~',
        'SBR*P*18*' || coalesce(payer_id, '') || '*' || coalesce(payer_id, '') || '****CI~',
        'NM1*IL*1*PATIENT*LAST*****MI*' || patient_id || '~',
        'CLM*' || claim_id || '*' || billed || '***11:B:1*Y*A*Y*I~', 'DTP*472*D8*' || sd || '~',
        'HI*' || coalesce('ABK:' || replace(icd, '.', ''), '') || '~',
        'NM1*82*1*PROVIDER*FIRST*****XX*' || provider_id || '~', 'LX*1~',
        'SV1*HC:' || cpt || '*' || billed || '*UN*1***1~', 'DTP*472*D8*' || sd || '~', 'SE*12*' || st || '~'])
        AS segment, unnest(range(13)) + 2 + (no - 1) * 13 AS position FROM n),
    b AS (SELECT batch, count(*) AS k FROM n GROUP BY batch),
    f AS (SELECT batch, unnest(['ISA*00*          *00*          *ZZ*CARELAKE       *ZZ*CLEARINGHOUSE  *240601*0730*^*00501*'
        || printf('%09d', batch) || '*0*P*:~', 'GS*HC*CARELAKE*CLEARINGHS*20240601*0730*' || batch || '*X*005010X222A1~',
        'GE*' || k || '*' || batch || '~', 'IEA*1*' || printf('%09d', batch) || '~']) AS segment,
        unnest([0, 1, 2 + k * 13, 3 + k * 13]) AS position FROM b),
    a AS (SELECT * FROM s UNION ALL SELECT * FROM f)
    SELECT CAST(batch AS BIGINT) AS batch, CAST(position AS BIGINT) AS position, segment FROM a""")
def _(spark, sf):
    return export.edi_837(_claims_with_gaps(spark, sf), "2024-06-01 07:30:00").select("batch", "position", "segment")


COUNTS = {"payers": "d_payer", "facilities": "d_facility", "providers": "d_provider", "patients": "d_patient",
          "claims": "s_claims", "labs": "s_labs", "prescriptions": "s_rx", "financials": "s_fin"}


# Rows that reach the warehouse: one per claim and fill id.
LOADED = {**COUNTS, "claims": "f_claims", "prescriptions": "f_rx"}


@entry("load_manifest", " UNION ALL ".join(
    f"SELECT '{RUN_DATE}' AS run_date, '{e}' AS entity, count(*) AS row_count, 'ok' AS status FROM {b}"
    for e, b in COUNTS.items()))
def _(spark, sf):
    return landing.load_manifest({e: td.landing(spark, sf, e) for e in ENTITIES}, RUN_DATE)


# --- dimensions ------------------------------------------------------------------------------

@entry("build_dim_date", f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS "DateKey", d AS "FullDate", {DATE_PARTS}
    FROM (SELECT CAST(unnest(generate_series(make_date(CAST(year(min(o_orderdate)) AS INTEGER), 1, 1),
        make_date(CAST(year(max(o_orderdate)) AS INTEGER), 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
    UNION ALL SELECT 0, DATE '1900-01-01', 0::SMALLINT, 'Unknown', 0::SMALLINT, 0::SMALLINT, 0::SMALLINT, 0::SMALLINT,
        'Unknown', 0::SMALLINT, 'Q0', 0::SMALLINT, false, 0::SMALLINT, 0::SMALLINT""")
def _(spark, sf):
    span = td.read(spark, sf, "orders").agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    return dimensions.build_dim_date(spark, f"{span[0]}-01-01", f"{span[1]}-12-31")


@entry("reference_dims", """SELECT d.code, d.descr AS description, count(s.claim_id) AS claims FROM dx d
    LEFT JOIN (SELECT coalesce(x.code, 'UNKNOWN') AS code, claim_id FROM f_claims LEFT JOIN dx x ON x.code = icd) s
    USING (code) GROUP BY ALL
    UNION ALL SELECT p.code, p.descr, count(s.claim_id) FROM px p
    LEFT JOIN (SELECT coalesce(x.code, 'UNKNOWN') AS code, claim_id FROM f_claims LEFT JOIN px x ON x.code = cpt) s
    USING (code) GROUP BY ALL""")
def _(spark, sf):
    claims, lists = warehouse_for(spark, sf)["FactClaims"], dimensions.reference_dims(spark)

    def used(name: str, key: str, code: str) -> DataFrame:
        per_key = claims.groupBy(key).agg(n_rows("claims"))
        return lists[name].join(per_key, key, "left").select(
            F.col(code).alias("code"), F.col("Description").alias("description"),
            F.coalesce("claims", F.lit(0)).alias("claims"))

    return used("DimDiagnosis", "DiagnosisKey", "ICD10Code").unionByName(used("DimProcedure", "ProcedureKey", "CPTCode"))


@entry("sentinel_rows", """SELECT 'diagnosis' AS dimension, count(*) FILTER (d.code IS NULL) AS unknown, count(*) AS facts
    FROM f_claims LEFT JOIN dx d ON d.code = icd
    UNION ALL SELECT 'procedure', count(*) FILTER (p.code IS NULL), count(*) FROM f_claims LEFT JOIN px p ON p.code = cpt
    UNION ALL SELECT 'drug', count(*) FILTER (n.code IS NULL), count(*) FROM f_rx s LEFT JOIN ndc n ON n.code = s.code
    UNION ALL SELECT 'patient', count(*) FILTER (p.id IS NULL), count(*) FROM s_labs s LEFT JOIN d_patient p
        ON p.id = s.patient_id""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    part = lambda name, fact, key: wh[fact].agg(
        F.count_if(F.col(key) == ref.UNKNOWN_KEY).alias("unknown"), n_rows("facts")).select(
        F.lit(name).alias("dimension"), "unknown", "facts")
    return (part("diagnosis", "FactClaims", "DiagnosisKey").unionByName(part("procedure", "FactClaims", "ProcedureKey"))
            .unionByName(part("drug", "FactPrescriptions", "DrugKey"))
            .unionByName(part("patient", "FactLabResults", "PatientKey")))


@entry("scd1_upsert", """WITH a AS (SELECT *, row_number() OVER (ORDER BY id) + 1 AS k FROM d_provider),
    n AS (SELECT 'N' || id AS id, name, 'Urology' AS specialty, years,
        row_number() OVER (ORDER BY 'N' || id) + (SELECT max(k) FROM a) AS k FROM d_provider WHERE years < 3)
    SELECT CAST(k AS BIGINT) AS "ProviderKey", id AS "ProviderID", name AS "FullName",
        CASE WHEN years >= 20 THEN 'Urology' ELSE specialty END AS "Specialty",
        CASE WHEN years >= 20 THEN DATE '2024-06-02' ELSE DATE '2024-06-01' END AS updated FROM a
    UNION ALL SELECT k, id, name, specialty, DATE '2024-06-02' FROM n
    UNION ALL SELECT 1, '00000000-0000-0000-0000-000000000000', 'Unknown Unknown', NULL, NULL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    base = td.staged(spark, sf, "providers").withColumn("specialty", F.lit("Urology"))
    years = F.col("years_experience").cast("int")
    added = base.where(years < 3).withColumn("provider_id", F.concat(F.lit("N"), F.col("provider_id")))
    second = base.where(years >= 20).unionByName(added)
    new = dimensions.load_dim_provider(wh["DimProvider"], second, wh["DimFacility"], SECOND_LOAD)
    return new.select("ProviderKey", "ProviderID", "FullName", "Specialty", F.to_date("DWUpdatedAt").alias("updated"))


@entry("scd2_apply", """WITH a AS (SELECT *, row_number() OVER (ORDER BY id) + 1 AS k FROM d_patient),
    c AS (SELECT *, c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS changed,
        CASE WHEN c_custkey % 11 = 0 THEN 'ZZ' ELSE state END AS state2,
        CASE WHEN c_custkey % 7 <> 0 THEN payer_id WHEN payer_id = 'BUILDING' THEN 'HOUSEHOLD' ELSE 'BUILDING' END
            AS payer2 FROM a),
    fresh AS (SELECT id, state2 AS state, payer2 AS payer_id FROM c WHERE changed
        UNION ALL SELECT 'N' || c_custkey, state, payer_id FROM c WHERE c_custkey % 13 = 0),
    added AS (SELECT *, row_number() OVER (ORDER BY id) + (SELECT max(k) FROM a) AS k FROM fresh)
    SELECT CAST(k AS BIGINT) AS "PatientKey", id AS "PatientID", state AS "State", payer_id AS payer,
        NOT changed AS "IsCurrent", DATE '2024-06-01' AS "EffectiveDate",
        CASE WHEN changed THEN DATE '2024-06-01' END AS "ExpirationDate" FROM c
    UNION ALL SELECT k, id, state, payer_id, true, DATE '2024-06-02', NULL FROM added
    UNION ALL SELECT 1, '00000000-0000-0000-0000-000000000000', NULL, NULL, true, DATE '1900-01-01', NULL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    new = dimensions.load_dim_patient(wh["DimPatient"], td.second_patient_load(spark, sf), wh["DimPayer"],
                                      wh["DimProvider"], SECOND_LOAD)
    payer = wh["DimPayer"].select(F.col("PayerKey").alias("PrimaryPayerKey"), F.col("PayerID").alias("payer"))
    return new.join(payer, "PrimaryPayerKey", "left").select(
        "PatientKey", "PatientID", "State", "payer", "IsCurrent", "EffectiveDate", "ExpirationDate")


@entry("surrogate_keys", """SELECT o_orderpriority, count(*) AS n, CAST(min(k) AS BIGINT) AS lowest,
    CAST(max(k) AS BIGINT) AS highest, CAST(sum(k) AS DECIMAL(38,0)) AS key_sum FROM (
    SELECT o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 500 AS k FROM orders) GROUP BY ALL""")
def _(spark, sf):
    orders = td.read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    keyed = keys.surrogate_keys(orders, "k", ["o_totalprice", "o_orderkey"], start=500)
    return keyed.groupBy("o_orderpriority").agg(
        n_rows("n"), F.min("k").alias("lowest"), F.max("k").alias("highest"),
        F.sum(F.col("k").cast("decimal(20,0)")).cast("decimal(38,0)").alias("key_sum"))


@entry("batch_numbering", """SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(cid) AS first_id,
    max(cid) AS last_id, CAST(max(no) AS BIGINT) AS top_no FROM (SELECT cid, pos // 1000 + 1 AS batch, pos % 1000 + 1 AS no
    FROM (SELECT cid, row_number() OVER (ORDER BY cid) - 1 AS pos FROM lines)) GROUP BY ALL""")
def _(spark, sf):
    ids = td.landing(spark, sf, "claims").select(F.col("claim_id").alias("cid"))
    return keys.batch_numbering(ids, "cid", 1000).groupBy("batch").agg(
        n_rows("n"), F.min("cid").alias("first_id"), F.max("cid").alias("last_id"), F.max("no").alias("top_no"))


# --- facts -----------------------------------------------------------------------------------

def _fact_load(spark: SparkSession, sf: str, name: str, entity: str) -> DataFrame:
    """The load of one fact against the stored dimensions, computed anew."""
    wh = warehouse_for(spark, sf)
    names = {d for d, _, _ in facts.LOOKUPS[name].values()} | {"DimDate"}
    return facts.load_fact(name, empty_table(spark, name), td.staged(spark, sf, entity), wh.tables(*names), td.LOADED_AT)


@entry("load_fact_claims", f"""SELECT CAST(year(service_date) AS INTEGER) AS year, status AS "ClaimStatus",
    count(*) AS claims, count(DISTINCT claim_id) AS ids, {total('billed')} AS billed, {total('allowed')} AS allowed,
    {total('paid')} AS paid, count(*) FILTER (d.code IS NULL) AS unknown_diagnosis,
    count(DISTINCT patient_id) AS patients, count(denial_reason) AS denials
    FROM f_claims LEFT JOIN dx d ON d.code = icd GROUP BY ALL""")
def _(spark, sf):
    return _fact_load(spark, sf, "FactClaims", "claims").groupBy(F.col("PartitionYear").alias("year"), "ClaimStatus").agg(
        n_rows("claims"), F.count_distinct("ClaimID").alias("ids"), F.sum("BilledAmount").cast(TOTAL).alias("billed"),
        F.sum("AllowedAmount").cast(TOTAL).alias("allowed"), F.sum("PaidAmount").cast(TOTAL).alias("paid"),
        F.count_if(F.col("DiagnosisKey") == 1).alias("unknown_diagnosis"),
        F.count_distinct("PatientKey").alias("patients"), F.count("DenialReason").alias("denials"))


@entry("load_fact_labs", f"""SELECT CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS "OrderDateKey", count(*) AS labs,
    {total('value')} AS results, count(DISTINCT patient_id) AS patients, max(result_date) AS last_result
    FROM s_labs GROUP BY ALL""")
def _(spark, sf):
    last = F.to_date(F.max("ResultDateKey").cast("string"), "yyyyMMdd")
    return _fact_load(spark, sf, "FactLabResults", "labs").groupBy("OrderDateKey").agg(
        n_rows("labs"), F.sum("ResultValue").cast(TOTAL).alias("results"),
        F.count_distinct("PatientKey").alias("patients"), last.alias("last_result"))


@entry("load_fact_prescriptions", f"""SELECT CAST(year(prescribed) AS INTEGER) AS year, days AS "DaysSupply",
    count(*) AS fills, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(refills_left) AS BIGINT) AS refills_left,
    {total('patient_cost + payer_cost')} AS cost, count(*) FILTER (n.code IS NULL) AS unknown_drug
    FROM f_rx s LEFT JOIN ndc n ON n.code = s.code GROUP BY ALL""")
def _(spark, sf):
    return _fact_load(spark, sf, "FactPrescriptions", "prescriptions").groupBy(
        F.col("PartitionYear").alias("year"), "DaysSupply").agg(
        n_rows("fills"), F.sum("Quantity").alias("quantity"), F.sum("RefillsRemaining").alias("refills_left"),
        F.sum("TotalCost").cast(TOTAL).alias("cost"), F.count_if(F.col("DrugKey") == 1).alias("unknown_drug"))


@entry("load_fact_financials", f"""SELECT CAST(year(day) AS SMALLINT) AS "FiscalYear", kind AS "TransactionType",
    gl AS "GLAccount", count(*) AS transactions, {total('amount')} AS amount,
    count(DISTINCT cost_center) AS cost_centers FROM s_fin GROUP BY ALL""")
def _(spark, sf):
    return _fact_load(spark, sf, "FactFinancials", "financials").groupBy("FiscalYear", "TransactionType", "GLAccount").agg(
        n_rows("transactions"), F.sum("Amount").cast(TOTAL).alias("amount"),
        F.count_distinct("CostCenter").alias("cost_centers"))


@entry("reload_skips_known_facts", """SELECT count(*) FILTER (s_nationkey = 3) AS inserted FROM f_claims
    JOIN supplier ON 'P' || s_suppkey = provider_id""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    gone = wh["DimFacility"].where(F.col("FacilityID") == "F3").select("FacilityKey")
    loaded = wh["FactClaims"].join(F.broadcast(gone), "FacilityKey", "left_anti")
    names = {d for d, _, _ in facts.LOOKUPS["FactClaims"].values()} | {"DimDate"}
    fresh = facts.new_fact_rows("FactClaims", td.staged(spark, sf, "claims"), loaded, wh.tables(*names), SECOND_LOAD)
    return fresh.agg(n_rows("inserted"))


@entry("reload_by_id_index", """SELECT CASE WHEN s_nationkey = 3 THEN 'inserted' ELSE 'known' END AS claims, count(*) AS n FROM f_claims
    JOIN supplier ON 'P' || s_suppkey = provider_id GROUP BY ALL""")
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    gone = wh["DimFacility"].where(F.col("FacilityID") == "F3").select("FacilityKey")
    loaded = wh["FactClaims"].join(F.broadcast(gone), "FacilityKey", "left_anti")
    index = facts.fact_index(spark, scratch_dir(spark, "ids"), "FactClaims", buckets=16)
    # two generations: the older half of the keys first
    middle = loaded.agg(F.percentile_approx("ClaimKey", 0.5)).first()[0]
    index.catch_up(loaded.where(F.col("ClaimKey") <= middle))
    index.catch_up(loaded)
    # the batch is counted, asked about and loaded: staged once, its joins run once
    staging = StagingArea(spark, scratch_dir(spark, "reload"))
    staging.add(td.staged(spark, sf, "claims"), "claims", "1")
    staged = staging.read_pending("claims", ["1"])
    names = {d for d, _, _ in facts.LOOKUPS["FactClaims"].values()} | {"DimDate"}
    fresh = facts.new_fact_rows("FactClaims", staged, loaded, wh.tables(*names), SECOND_LOAD, index=index)
    known = index.known(staged.select(F.col("claim_id").alias("id"))).distinct()
    return fresh.select(F.lit("inserted").alias("claims")).unionByName(known.select(F.lit("known").alias("claims"))).groupBy("claims").agg(n_rows("n"))


@entry("row_count_check", """SELECT 'DimPatient' AS table_name, count(*) + 1 AS row_count FROM d_patient
    UNION ALL SELECT 'DimProvider', count(*) + 1 FROM d_provider UNION ALL SELECT 'FactClaims', count(*) FROM f_claims
    UNION ALL SELECT 'FactLabResults', count(*) FROM s_labs UNION ALL SELECT 'FactPrescriptions', count(*) FROM f_rx
    UNION ALL SELECT 'FactFinancials', count(*) FROM s_fin""")
def _(spark, sf):
    return quality.row_count_check(warehouse_for(spark, sf).tables(*quality.COUNTED))


def _integrity_sql() -> str:
    """The planted faults of ``integrity_report``; every other rule holds."""
    planted = {
        ("FactClaims", "unique", "ClaimID"): "SELECT count(*) - count(DISTINCT list_slice(string_split(claim_id, '-'), 1, 2)) FROM f_claims",
        ("FactClaims", "foreign_key", "ProviderKey"):
            "SELECT count(*) FROM f_claims JOIN d_provider r ON r.id = provider_id WHERE r.specialty = 'Oncology'",
        ("FactPrescriptions", "foreign_key", "ProviderKey"):
            "SELECT count(*) FROM f_rx JOIN d_provider r ON r.id = provider_id WHERE r.specialty = 'Oncology'",
        ("FactLabResults", "foreign_key", "ProviderKey"):
            "SELECT count(*) FROM s_labs JOIN d_provider r ON r.id = provider_id WHERE r.specialty = 'Oncology'",
        ("DimPatient", "foreign_key", "PrimaryProviderKey"):
            "SELECT count(*) FROM d_patient p JOIN d_provider r ON r.id = p.provider_id WHERE r.specialty = 'Oncology'",
        ("FactFinancials", "not_null", "Amount"): "SELECT count(*) FROM s_fin WHERE kind = 'Write-off'",
    }
    rules = []
    for table in quality.NOT_NULL:
        rules += [(table, "not_null", c) for c in quality.NOT_NULL[table]]
        rules += [(table, "unique", c) for c in quality.UNIQUE[table]]
        rules += [(table, "foreign_key", c) for c in quality.FOREIGN.get(table, {})]
    rules.append(("DimPatient", "one_current_version", "PatientID"))
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{r}' AS rule, '{c}' AS column_name, ({planted.get((t, r, c), 'SELECT 0::BIGINT')})"
        " AS violations" for t, r, c in rules)


@entry("integrity_report", _integrity_sql())
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    tables = wh.tables("DimDate", "DimPayer", "DimFacility", "DimProvider", "DimPatient", "DimDiagnosis",
                       "DimProcedure", "DimDrug", *FACTS)
    short_id = F.concat_ws("-", F.slice(F.split("ClaimID", "-"), 1, 2))
    tables["FactClaims"] = tables["FactClaims"].withColumn("ClaimID", short_id)
    tables["DimProvider"] = tables["DimProvider"].where(~F.col("Specialty").eqNullSafe("Oncology"))
    tables["FactFinancials"] = tables["FactFinancials"].withColumn(
        "Amount", F.when(F.col("TransactionType") != "Write-off", F.col("Amount")))
    return quality.integrity_report(tables)


@entry("mark_processed", """SELECT CASE WHEN flag = 'Normal' THEN 'Pending' ELSE 'Processed' END AS stg_status,
    count(*) AS labs FROM f_labs GROUP BY ALL""")
def _(spark, sf):
    stg = td.staged(spark, sf, "labs")
    loaded = stg.where(F.col("abnormal_flag") != "Normal").select("stg_load_id")
    return mark_processed(stg, True, loaded).groupBy("stg_status").agg(n_rows("labs"))


# --- a complete run ----------------------------------------------------------------------------

_runs: dict[int, Etl] = {}


def _two_loads(spark: SparkSession, sf: str) -> Etl:
    """First load, then a patient file and a repeated claims file."""
    wh = warehouse_for(spark, sf)
    if id(wh) not in _runs:
        etl = Etl(spark, scratch_dir(spark, "etl"), td.CALENDAR)
        for entity in ENTITIES:
            etl.staging.add(td.staged(spark, sf, entity), entity, "1")
        etl.run_all(td.LOADED_AT)
        etl.staging.add(td.second_patient_load(spark, sf), "patients", "2")
        etl.staging.add(td.staged(spark, sf, "claims"), "claims", "2")
        etl.run_all(SECOND_LOAD)
        _runs[id(wh)] = etl
    return _runs[id(wh)]


CHANGED = "(c_custkey % 7 = 0 OR c_custkey % 11 = 0)"
LOG_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS log_id, '{name}' AS entity, count(*) AS ins, 0::BIGINT AS upd, "
    f"(SELECT count(*) FROM {COUNTS[e]}) - count(*) AS skip FROM {LOADED[e]}"
    for i, (name, e) in enumerate(STEPS.items(), 1)) + f"""
    UNION ALL SELECT 12, 'DimPatient', (SELECT count(*) FROM customer WHERE {CHANGED})
        + (SELECT count(*) FROM customer WHERE c_custkey % 13 = 0), (SELECT count(*) FROM customer WHERE {CHANGED}), 0
    UNION ALL SELECT 13, 'FactClaims', 0, 0, (SELECT count(*) FROM s_claims)
    UNION ALL SELECT i, e, 0, 0, 0 FROM (VALUES (9, 'DimPayer'), (10, 'DimFacility'), (11, 'DimProvider'),
        (14, 'FactLabResults'), (15, 'FactPrescriptions'), (16, 'FactFinancials')) t(i, e)"""


@entry("etl_run_all", f"""SELECT CAST(log_id AS BIGINT) AS "LogID", entity AS "Entity", ins AS "RowsInserted",
    upd AS "RowsUpdated", skip AS "RowsSkipped", ins + upd AS rows_affected, 'Success' AS "Status" FROM ({LOG_ROWS})""")
def _(spark, sf):
    return rows_affected(_two_loads(spark, sf).log.read()).select(
        "LogID", "Entity", "RowsInserted", "RowsUpdated", "RowsSkipped", "rows_affected", "Status")


@entry("etl_log", """SELECT 'Success' AS "Status", 16::BIGINT AS steps, 16::BIGINT AS timed,
    (SELECT count(*) FROM f_claims) AS claims""")
def _(spark, sf):
    log = etl_log(_two_loads(spark, sf).log.read())
    claims = F.sum(F.when(F.col("Entity") == "FactClaims", F.col("RowsInserted"))).alias("claims")
    return log.groupBy("Status").agg(n_rows("steps"), F.count_if(F.col("DurationSec") >= 0).alias("timed"), claims)


@entry("latest_etl_runs", f"""SELECT CAST(log_id AS BIGINT) AS "LogID", entity AS "Entity", ins AS "RowsInserted",
    upd AS "RowsUpdated", skip AS "RowsSkipped", 'Success' AS "Status", CAST(NULL AS VARCHAR) AS "ErrorMessage"
    FROM ({LOG_ROWS}) ORDER BY log_id DESC LIMIT 10""")
def _(spark, sf):
    return proc.latest_etl_runs(_two_loads(spark, sf).log.read(), 10)


@entry("recent_runs", """SELECT user_id, count(*) AS recent FROM events
    WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTE GROUP BY ALL""")
def _(spark, sf):
    from carelake.functions.predicates import recent_runs
    log = td.read(spark, sf, "events").withColumn("RunStarted", F.col("ts"))
    return recent_runs(log, "2024-01-15 12:00:00").groupBy("user_id").agg(n_rows("recent"))


@entry("staging_status", """SELECT 'claims' AS entity, 'Processed' AS stg_status, 2 * count(*) AS n FROM s_claims
    UNION ALL SELECT 'patients', 'Processed', 2 * count(*) + (SELECT count(*) FROM customer WHERE c_custkey % 13 = 0)
    FROM customer""")
def _(spark, sf):
    staging = _two_loads(spark, sf).staging
    part = lambda e: staging.read(e).groupBy(F.lit(e).alias("entity"), "stg_status").agg(n_rows("n"))
    return part("claims").unionByName(part("patients"))


@entry("expired_versions_drop_out", f"""SELECT status AS "ClaimStatus", count(*) AS claims FROM f_claims
    JOIN customer ON 'C' || c_custkey = patient_id WHERE NOT {CHANGED} GROUP BY ALL""")
def _(spark, sf):
    from carelake.plans.views import VIEW_TABLES, vw_claims_summary
    etl = _two_loads(spark, sf)
    tables = {n: etl.table(n) for n in VIEW_TABLES["vw_ClaimsSummary"]}
    return vw_claims_summary(tables).groupBy("ClaimStatus").agg(n_rows("claims"))


# --- usage and budgets ---------------------------------------------------------------------------

def _small_budgets(spark: SparkSession) -> DataFrame:
    """A hundredth of each configured budget, so some sessions go over."""
    return usage.budget_table(spark).withColumn("token_budget", (F.col("token_budget") / 100).cast("bigint"))


BUDGETED = """SELECT "AgentName", "SessionID", CAST(sum("InputTokens" + "OutputTokens") AS BIGINT) AS used,
    coalesce(max(CAST(budget AS BIGINT)) // {div}, 20000) AS token_budget FROM usage
    LEFT JOIN budgets ON agent = "AgentName" GROUP BY ALL"""


@entry("tokens_remaining", f"""SELECT *, token_budget - used AS remaining FROM ({BUDGETED.format(div=1)})""")
def _(spark, sf):
    return usage.tokens_remaining(td.usage_log(spark, sf), usage.budget_table(spark))


@entry("budget_join", f"""SELECT *, token_budget - used AS remaining, token_budget - used < 2000 AS escalate
    FROM ({BUDGETED.format(div=100)})""")
def _(spark, sf):
    return usage.budget_join(td.usage_log(spark, sf), _small_budgets(spark))


@entry("budget_crossing", """SELECT "AgentName", "SessionID", "LogID", tokens, running_tokens, token_budget,
    running_tokens > token_budget AND running_tokens - tokens <= token_budget AS crosses FROM (
    SELECT "AgentName", "SessionID", "LogID", CAST("InputTokens" + "OutputTokens" AS BIGINT) AS tokens,
    CAST(sum("InputTokens" + "OutputTokens") OVER (PARTITION BY "AgentName", "SessionID" ORDER BY "LogID") AS BIGINT)
        AS running_tokens, CAST(budget AS BIGINT) // 100 AS token_budget FROM usage JOIN budgets ON agent = "AgentName")""")
def _(spark, sf):
    return usage.budget_crossing(td.usage_log(spark, sf), _small_budgets(spark))


@entry("usage_record", """SELECT event_type AS "AgentName", count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS "InputTokens",
    0::BIGINT AS "OutputTokens", count(DISTINCT event_id) AS ids FROM events GROUP BY ALL""")
def _(spark, sf):
    rows = td.read(spark, sf, "events").select(
        F.col("event_type").alias("AgentName"), F.lit("S").alias("SessionID"), F.col("user_id").alias("InputTokens"))
    new = usage.usage_record(td.usage_log(spark, sf), rows, td.LOADED_AT)
    return new.groupBy("AgentName").agg(n_rows("calls"), F.sum("InputTokens").alias("InputTokens"),
                                        F.sum("OutputTokens").alias("OutputTokens"),
                                        F.count_distinct("LogID").alias("ids"))


# --- answer cache -----------------------------------------------------------------------------------

LIVE = "expires > TIMESTAMP '2024-01-01 00:20:00'"


@entry("cache_exact_lookup", f"""SELECT request_id, a.answer AS "Response" FROM asked r LEFT JOIN
    (SELECT * FROM answers WHERE {LIVE}) a ON a.agent = r.agent AND a.question = r.question""")
def _(spark, sf):
    hits = cache.cache_exact_lookup(td.cache_requests(spark, sf), td.answer_cache(spark, sf), td.CACHE_AS_OF)
    return hits.select("request_id", "Response")


SCORES = f"""SELECT r.request_id, a.id, list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))
    AS score FROM asked r JOIN answers a ON a.agent = r.agent WHERE {LIVE}"""


@entry("semantic_candidate", f"""SELECT request_id, id AS "CacheID", round(score, 6) AS score,
    'question ' || id AS "MatchedQuery", 'answer ' || id AS "Response" FROM (SELECT *, row_number() OVER (
    PARTITION BY request_id ORDER BY score DESC, id) AS rn FROM ({SCORES})) WHERE rn = 1 AND score >= 0.25""")
def _(spark, sf):
    best = cache.semantic_candidate(td.cache_requests(spark, sf), td.answer_cache(spark, sf), td.CACHE_AS_OF,
                                    floor=0.25)
    return best.select("request_id", "CacheID", F.round("Score", 6).alias("score"), "MatchedQuery", "Response")


@entry("best_match_per_request", f"""SELECT request_id, arg_max(id, score) AS "CacheID", round(max(score), 6) AS score
    FROM ({SCORES}) GROUP BY request_id""")
def _(spark, sf):
    from carelake.functions.predicates import unexpired
    from carelake.operators.similarity import ClusteredCache
    live = unexpired(td.answer_cache(spark, sf), td.CACHE_AS_OF).select("AgentName", "CacheID", "Embedding")
    scored = ClusteredCache(live).lookup(td.cache_requests(spark, sf).select("request_id", "AgentName", "embedding"), floor=-1.0)
    return cache.best_match_per_request(scored).select("request_id", "CacheID", F.round("Score", 6).alias("score"))


@entry("cache_upsert", """SELECT agent AS "AgentName", question AS "Query", min(answer) AS "Response",
    count(*) AS entries, max(minutes) AS minutes FROM (
    SELECT agent, question, answer, 0 AS minutes FROM answers a WHERE NOT EXISTS (
        SELECT 1 FROM asked r WHERE r.agent = a.agent AND r.question = a.question)
    UNION ALL SELECT agent, '  Question ' || substr(question, 10) || ' ', 'new ' || max(request_id), 45 FROM asked
    GROUP BY agent, question) GROUP BY ALL""")
def _(spark, sf):
    entries = td.cache_requests(spark, sf).select(
        "AgentName", "Query", F.concat(F.lit("new "), F.col("request_id").cast("string")).alias("Response"),
        F.col("request_id").alias("entry_no"))
    merged = cache.cache_upsert(td.answer_cache(spark, sf), entries, td.CACHE_AS_OF, ttl_minutes=45)
    minutes = F.when(F.col("Response").startswith("new "), F.timestamp_diff("MINUTE", "CreatedAt", "ExpiresAt").cast("int"))
    return merged.groupBy("AgentName", "Query").agg(
        F.min("Response").alias("Response"), n_rows("entries"), F.max(F.coalesce(minutes, F.lit(0))).alias("minutes"))


@entry("cache_invalidate", """SELECT agent AS "AgentName", count(*) AS entries FROM answers
    WHERE agent NOT IN ('Agent1', 'Agent2') GROUP BY ALL""")
def _(spark, sf):
    kept = cache.cache_invalidate(td.answer_cache(spark, sf), ["Agent1", "Agent2"])
    return kept.groupBy("AgentName").agg(n_rows("entries"))


# --- search and access -------------------------------------------------------------------------------

QUERY_TEXT = "the heon src1"


def _score_sql(col: str) -> str:
    parts = []
    for w in search.query_words(QUERY_TEXT):
        parts.append(f"CASE WHEN lower({col}) = '{w}' THEN 10 WHEN regexp_matches(lower({col}), "
                     f"'(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') THEN 5 WHEN contains(lower({col}), '{w}') "
                     "THEN 2 ELSE 0 END")
    return " + ".join(parts)


SCORED = f"SELECT doc_id, CAST({_score_sql('text')} + {_score_sql('source')} AS INTEGER) AS score FROM documents"


@entry("keyword_scores", f"SELECT * FROM ({SCORED}) WHERE score > 0")
def _(spark, sf):
    return search.keyword_scores(td.read(spark, sf, "documents"), ["text", "source"], QUERY_TEXT).select("doc_id", "score")


@entry("keyword_search", f"SELECT * FROM ({SCORED}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, sf):
    return search.keyword_search(td.read(spark, sf, "documents"), ["text", "source"], QUERY_TEXT, "doc_id", 10)


@entry("keyword_search_many", """WITH kw_terms AS (SELECT DISTINCT doc_id, col, term, term = text AS whole FROM (
        SELECT doc_id, col, text, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM (
            SELECT doc_id, 1 AS col, lower(text) AS text FROM documents
            UNION ALL SELECT doc_id, 2, lower(source) FROM documents))),
    kw_asked AS (SELECT item_id, word, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark) GROUP BY ALL),
    held AS (SELECT w.word, t.term FROM (SELECT DISTINCT word FROM kw_asked) w, (SELECT DISTINCT term FROM kw_terms) t
        WHERE contains(t.term, w.word)),
    points AS (SELECT word, doc_id, col, max(CASE WHEN h.term <> h.word THEN 2 WHEN whole THEN 10 ELSE 5 END) AS points
        FROM held h JOIN kw_terms t ON t.term = h.term GROUP BY ALL),
    scored AS (SELECT item_id, doc_id, CAST(sum(times * points) AS BIGINT) AS score FROM kw_asked JOIN points USING (word)
        GROUP BY ALL)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (
        PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10""")
def _(spark, sf):
    from carelake.operators.inverted_index import KeywordIndex
    asked = td.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = KeywordIndex(td.read(spark, sf, "documents"), "doc_id", ["text", "source"]).search(asked, 10)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


PROFILED = {"ClaimID": "string", "ClaimStatus": "string", "DenialReason": "string", "BilledAmount": "decimal(10,2)",
            "ServiceDate": "date", "PatientAgeAtService": "int", "PayerType": "string"}


@entry("column_profile", " UNION ALL ".join(
    f"""SELECT 'vw_ClaimsSummary' AS table_name, '{c}' AS column_name, '{t}' AS data_type,
    '{ref.COLUMN_DESCRIPTIONS.get(c, '')}' AS description, count(*) AS row_count, count(*) - count("{c}") AS null_count,
    count(DISTINCT "{c}") AS distinct_count, CAST(min("{c}") AS VARCHAR) AS min_value,
    CAST(max("{c}") AS VARCHAR) AS max_value FROM v_claims""" for c, t in PROFILED.items()))
def _(spark, sf):
    view = warehouse_for(spark, sf).view("vw_ClaimsSummary").select(*PROFILED)
    return profile.column_profile({"vw_ClaimsSummary": view})


ALL_VIEWS = {"vw_ClaimsSummary": "SELECT * EXCLUDE (years_experience) FROM v_claims",
             "vw_FinancialKPIs": "SELECT * EXCLUDE (facility_id) FROM v_fin", "vw_LabResults": "SELECT * FROM v_labs",
             "vw_Prescriptions": "SELECT * FROM v_rx", "vw_ProviderPerformance": "SELECT * FROM v_performance"}
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def _profile_sql(view: str, rows: str) -> str:
    def per_column(name: str, aggregate: str) -> str:
        return f"(UNPIVOT (SELECT {aggregate} AS '\\1' FROM ({rows})) ON COLUMNS(*) INTO NAME column_name VALUE {name})"
    bound = lambda c: (f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN CAST(CAST({c} AS DECIMAL(38,4)) AS VARCHAR) "  # noqa: E731
                       f"ELSE nullif({c}, '<none>') END AS {c}")
    every = "COLUMNS('(.*)')"
    return f"""SELECT '{view}' AS table_name, column_name, (SELECT count(*) FROM ({rows})) AS row_count,
        (SELECT count(*) FROM ({rows})) - held AS null_count, distinct_count, {bound("min_value")}, {bound("max_value")}
        FROM {per_column("held", f"count({every})")} JOIN {per_column("distinct_count", f"count(DISTINCT {every})")} USING (column_name)
        JOIN {per_column("min_value", f"coalesce(CAST(min({every}) AS VARCHAR), '<none>')")} USING (column_name)
        JOIN {per_column("max_value", f"coalesce(CAST(max({every}) AS VARCHAR), '<none>')")} USING (column_name)"""


ALL_PROFILES = " UNION ALL ".join(_profile_sql(v, rows) for v, rows in ALL_VIEWS.items())


@entry("column_profile_all_views", ALL_PROFILES)
def _(spark, sf):
    wh = warehouse_for(spark, sf)
    bound = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c).cast("decimal(38,4)").cast("string")).otherwise(F.col(c)).alias(c)
    return profile.column_profile({n: wh.view(n) for n in ALL_VIEWS}).select(
        "table_name", "column_name", "row_count", "null_count", "distinct_count", bound("min_value"), bound("max_value"))


@entry("column_sketches", f"SELECT table_name, column_name, row_count, null_count, TRUE AS within FROM ({ALL_PROFILES})")
def _(spark, sf):
    """Sketches of two loads, merged, against the exact counts: within 6 per cent."""
    wh = warehouse_for(spark, sf)
    views = {n: wh.view(n) for n in ALL_VIEWS}
    part = lambda i: {n: v.where(F.pmod(F.xxhash64(*v.columns), F.lit(2)) == i) for n, v in views.items()}
    told = profile.sketch_profile(profile.merged(profile.sketches(part(0)), profile.sketches(part(1))))
    exact = profile.column_profile(views).select("table_name", "column_name", F.col("distinct_count").alias("exact"))
    error = F.abs(F.col("distinct_count") - F.col("exact"))
    return told.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "row_count", "null_count", (error <= 0.06 * F.col("exact")).alias("within"))


@entry("effective_access", """SELECT principal, object_name, permission, count(*) AS calls,
    bool_or((principal, object_name, permission) IN (SELECT (principal, object_name, permission) FROM allowed_access))
        AS allowed FROM access_events GROUP BY ALL""")
def _(spark, sf):
    allowed = access.effective_access(*access.policy_tables(spark)).withColumn("allowed", F.lit(True))
    per_use = td.access_log(spark, sf).groupBy("principal", "object_name", "permission").agg(n_rows("calls"))
    return per_use.join(allowed, ["principal", "object_name", "permission"], "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False)))


@entry("access_audit", """SELECT event_id, principal, object_name, permission FROM access_events e WHERE NOT EXISTS (
    SELECT 1 FROM allowed_access a WHERE a.principal = e.principal AND a.object_name = e.object_name
    AND a.permission = e.permission)""")
def _(spark, sf):
    return access.access_audit(td.access_log(spark, sf), access.effective_access(*access.policy_tables(spark)))


@entry("mask_bulk_patient", """SELECT sha256(id) AS "PatientID", CAST(NULL AS DATE) AS "DateOfBirth", state AS "State"
    FROM d_patient UNION ALL SELECT sha256('00000000-0000-0000-0000-000000000000'), NULL, NULL""")
def _(spark, sf):
    df = warehouse_for(spark, sf)["DimPatient"].select("PatientID", "DateOfBirth", "State")
    return access.mask_bulk_patient(df, ["PatientID"], ["DateOfBirth"])


# --- refused rows and repaired batches ------------------------------------------------------------

def _land_with_faults(spark, sf, folder: str) -> None:
    """Claims as CSV: some without an id, and a broken line for some."""
    claims, last = td.landing(spark, sf, "claims"), F.ascii(F.substring("claim_id", -1, 1))
    claims.withColumn("claim_id", F.when(last % 6 != 0, F.col("claim_id"))).write.mode("append").option("header", True).csv(folder)
    # a file's first line is its header; one small file of broken lines
    header = local_rows(spark, [("line",)], "value string")
    broken = claims.where(last % 9 == 0).select(F.concat(F.lit("broken,"), "claim_id").alias("value"))
    header.unionByName(broken).coalesce(1).write.mode("append").text(folder)


REFUSED = """SELECT 'bad line' AS reason, count(*) AS n FROM s_claims WHERE ascii(right(claim_id, 1)) % 9 = 0
    UNION ALL SELECT 'no id', count(*) FROM s_claims WHERE ascii(right(claim_id, 1)) % 6 = 0"""
WITH_ID = "SELECT count(DISTINCT claim_id) FROM s_claims WHERE ascii(right(claim_id, 1)) % 6 <> 0"


@entry("rejected_rows", f"""{REFUSED} UNION ALL SELECT 'loaded', ({WITH_ID}) UNION ALL SELECT 'skipped',
    (SELECT count(*) FROM s_claims) - ({WITH_ID})""")
def _(spark, sf):
    root = scratch_dir(spark, "rejects")
    _land_with_faults(spark, sf, f"{root}/claims.csv")
    lines = landing.csv_reader(spark.read, "claims").csv(f"{root}/claims.csv")
    etl = Etl(spark, f"{root}/warehouse", td.CALENDAR)
    etl.staging.reject(landing.bad_lines(lines, "claims"), "claims", "1", "bad line")
    etl.staging.add(landing.stage(lines, "claims", loaded_at=td.LOADED_AT), "claims", "1")
    etl.run_step("FactClaims", td.LOADED_AT)
    ran = etl.log.read().select(F.inline(F.array(F.struct(F.lit("loaded").alias("reason"), F.col("RowsInserted").alias("n")),
                                                 F.struct(F.lit("skipped").alias("reason"), F.col("RowsSkipped").alias("n")))))
    return etl.staging.rejected().groupBy("reason").agg(n_rows("n")).unionByName(ran.withColumn("n", F.col("n").cast("bigint")))


@entry("reload_repaired_batch", """SELECT 'first' AS run, count(*) AS "RowsInserted" FROM d_payer WHERE id <> 'BUILDING'
    UNION ALL SELECT 'repaired', 1""")
def _(spark, sf):
    etl = Etl(spark, scratch_dir(spark, "repaired"), td.CALENDAR)
    payers = td.staged(spark, sf, "payers")
    etl.staging.add(payers.where("payer_id != 'BUILDING'"), "payers", "1")
    etl.run_step("DimPayer", td.LOADED_AT)
    etl.staging.add(payers, "payers", "1")
    etl.run_step("DimPayer", SECOND_LOAD)
    return etl.log.read().select(F.when(F.col("LogID") == 1, "first").otherwise("repaired").alias("run"), F.col("RowsInserted").cast("bigint").alias("RowsInserted"))


# --- streams ---------------------------------------------------------------------------------------

@entry("landing_stream", " UNION ALL ".join(
    f"SELECT '{name}' AS \"Entity\", count(*) AS \"RowsInserted\" FROM {LOADED[e]}" for name, e in STEPS.items()))
def _(spark, sf):
    root = scratch_dir(spark, "stream")
    for entity in ENTITIES:
        td.landing(spark, sf, entity).write.option("header", True).option("compression", "gzip").csv(f"{root}/landing/{entity}")
    etl = Etl(spark, f"{root}/warehouse", td.CALENDAR)
    summary = landing_stream(spark, f"{root}/landing", f"{root}/checkpoint", etl, td.LOADED_AT, td.LOADED_AT)
    return summary.select("Entity", "RowsInserted")


@entry("usage_budget_stream", f"""SELECT *, token_budget - used AS remaining, token_budget - used < 2000 AS escalate
    FROM ({BUDGETED.format(div=100)})""")
def _(spark, sf):
    root = scratch_dir(spark, "usage-stream")
    schema = td.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf}/events.parquet*")
    usage_budget_stream(td.usage_rows(events), _small_budgets(spark), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return current_budgets(spark, f"{root}/state")


@entry("budget_crossing_stream", """SELECT "AgentName", "SessionID", min("LogID") AS "LogID" FROM (
    SELECT "AgentName", "SessionID", "LogID", sum("InputTokens" + "OutputTokens") OVER (
        PARTITION BY "AgentName", "SessionID" ORDER BY "LogID") AS used, CAST(budget AS BIGINT) // 100 AS token_budget
    FROM usage JOIN budgets ON agent = "AgentName") WHERE used > token_budget GROUP BY ALL""")
def _(spark, sf):
    root = scratch_dir(spark, "crossing-stream")
    events = spark.readStream.schema(td.read(spark, sf, "events").schema).option("maxFilesPerTrigger", 1000).parquet(f"{sf}/events.parquet*")
    usage_budget_stream(td.usage_rows(events), _small_budgets(spark), f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return crossings(spark, f"{root}/state")
