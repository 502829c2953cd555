"""Named SQL building blocks for the checks of the registered queries.

They restate the mapping of the given tables and the reporting views in plain
SQL, straight from the raw tables and without surrogate keys.  ``q`` puts the
blocks a statement mentions in front of it as WITH clauses.
"""

from __future__ import annotations

import re

from carelake import reference_data as ref
from carelake.sources import testdata as td


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def cased(col: str, mapping: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items()) + " END"


def rows(values, columns: str) -> str:
    body = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in values)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def total(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS DECIMAL(38,2))"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN coalesce(CAST({den} AS DOUBLE), 0) = 0 THEN 0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


_lab = lambda i: cased("event_type", {k: v[i] for k, v in td.LAB_TESTS.items()})
_UNKNOWN = text(ref.UNKNOWN_ID)

BLOCKS: dict[str, str] = {
    "dx": rows(ref.DIAGNOSES, "code, descr"),
    "px": rows(ref.PROCEDURES, "code, descr, price"),
    "ndc": rows(ref.DRUGS, "drug, code, dosage, frequency"),
    "budgets": rows([(a, b, m) for a, _, b, m in ref.AGENTS], "agent, budget, minutes"),
    "d_payer": f"""SELECT DISTINCT c_mktsegment AS id, c_mktsegment AS name,
        {cased('c_mktsegment', td.PAYER_TYPES)} AS type, {cased('c_mktsegment', td.PLAN_TYPES)} AS plan
        FROM customer""",
    "d_facility": f"""SELECT 'F' || n_nationkey AS id, n_name AS name,
        {listed(td.FACILITY_TYPES)}[n_nationkey % 5 + 1] AS type, {listed(td.STATES)}[n_nationkey % 20 + 1] AS state,
        CASE WHEN n_nationkey % 5 = 0 THEN 20 + n_nationkey END AS beds FROM nation""",
    "d_provider": f"""SELECT 'P' || s_suppkey AS id, 'Supplier ' || substr(s_name, 10) AS name,
        {listed(td.SPECIALTIES)}[s_suppkey % 20 + 1] AS specialty, s_suppkey % 40 AS years,
        'F' || s_nationkey AS facility_id FROM supplier""",
    "d_patient": f"""SELECT 'C' || c_custkey AS id, 'Customer ' || substr(c_name, 10) AS name,
        DATE '1930-01-01' + CAST(c_custkey * 37 % 23000 AS INTEGER) AS dob,
        CASE WHEN c_custkey % 50 = 0 THEN 'Other' WHEN c_custkey % 2 = 1 THEN 'M' ELSE 'F' END AS gender,
        {listed(td.STATES)}[c_nationkey % 20 + 1] AS state, c_mktsegment AS payer_id,
        'P' || (c_custkey % 10) AS provider_id, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "lines": """SELECT l.*, o_custkey, CAST(o_orderdate AS DATE) AS odate, c_mktsegment,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS cid,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS price
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "s_claims0": f"""SELECT cid AS claim_id, 'C' || o_custkey AS patient_id, 'P' || l_suppkey AS provider_id,
        'F' || s_nationkey AS facility_id, c_mktsegment AS payer_id, odate AS claim_date,
        CAST(l_shipdate AS DATE) AS service_date,
        {listed([c for c, _ in ref.DIAGNOSES[1:]] + ['ZZZ'])}[l_partkey % 16 + 1] AS icd,
        {listed([p[0] for p in ref.PROCEDURES[1:]] + ['ZZZZZ'])}[l_suppkey % 11 + 1] AS cpt, price AS billed,
        CAST(price * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS allowed,
        1 - CAST(l_tax AS DECIMAL(4,2)) AS share,
        CASE WHEN l_returnflag = 'A' THEN 'Approved' WHEN l_returnflag = 'R' THEN 'Denied'
             WHEN l_linestatus = 'O' THEN 'Pending' ELSE 'Appealed' END AS status,
        {listed(td.DENIAL_REASONS)}[l_linenumber % 6 + 1] AS reason
        FROM lines JOIN supplier ON l_suppkey = s_suppkey""",
    "s_claims": """SELECT * EXCLUDE (share, reason),
        CASE WHEN status = 'Approved' THEN CAST(allowed * share AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END
            AS paid,
        CASE WHEN status = 'Denied' THEN reason END AS denial_reason FROM s_claims0""",
    "f_claims": """SELECT * FROM s_claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY
        CAST(service_date AS VARCHAR) DESC, CAST(billed AS VARCHAR) DESC, CAST(allowed AS VARCHAR) DESC,
        CAST(paid AS VARCHAR) DESC, status DESC, coalesce(denial_reason, '') DESC) = 1""",
    "v_claims": f"""SELECT s.claim_id AS "ClaimID", s.status AS "ClaimStatus", s.denial_reason AS "DenialReason",
        s.billed AS "BilledAmount", s.allowed AS "AllowedAmount", s.paid AS "PaidAmount",
        CAST(s.allowed - s.paid AS DECIMAL(11,2)) AS "WriteOffAmount", s.service_date AS "ServiceDate",
        CAST(year(s.service_date) AS SMALLINT) AS "ServiceYear",
        CAST(quarter(s.service_date) AS SMALLINT) AS "ServiceQuarter", monthname(s.service_date) AS "ServiceMonth",
        CAST(month(s.service_date) AS SMALLINT) AS "ServiceMonthNum", s.claim_date AS "ClaimDate",
        coalesce(p.id, {_UNKNOWN}) AS "PatientID", coalesce(p.name, 'Unknown Unknown') AS "PatientName",
        p.gender AS "Gender", p.dob AS "DateOfBirth",
        CAST(year(s.service_date) - year(p.dob) AS INTEGER) AS "PatientAgeAtService", p.state AS "PatientState",
        coalesce(r.id, {_UNKNOWN}) AS "ProviderID", coalesce(r.name, 'Unknown Unknown') AS "ProviderName",
        r.specialty AS "ProviderSpecialty", coalesce(f.name, 'Unknown') AS "FacilityName",
        coalesce(f.type, 'Unknown') AS "FacilityType", f.state AS "FacilityState",
        coalesce(y.name, 'Unknown') AS "PayerName", coalesce(y.type, 'Unknown') AS "PayerType", y.plan AS "PlanType",
        coalesce(d.code, 'UNKNOWN') AS "ICD10Code", coalesce(d.descr, 'Unknown / Not Coded') AS "DiagnosisDescription",
        coalesce(c.code, 'UNKNOWN') AS "CPTCode", coalesce(c.descr, 'Unknown / Not Coded') AS "ProcedureDescription",
        CAST(coalesce(c.price, '0.00') AS DECIMAL(10,2)) AS "ProcedureBasePrice",
        CAST(r.years AS SMALLINT) AS years_experience
        FROM f_claims s LEFT JOIN d_patient p ON p.id = s.patient_id LEFT JOIN d_provider r ON r.id = s.provider_id
        LEFT JOIN d_facility f ON f.id = s.facility_id LEFT JOIN d_payer y ON y.id = s.payer_id
        LEFT JOIN dx d ON d.code = s.icd LEFT JOIN px c ON c.code = s.cpt""",
    "s_labs": f"""SELECT 'L' || event_id AS lab_id, 'C' || user_id AS patient_id, 'P' || (event_id % 10) AS provider_id,
        'F' || (event_id % 25) AS facility_id, CAST(ts AS DATE) AS order_date,
        CAST(ts AS DATE) + CAST(event_id % 4 + 1 AS INTEGER) AS result_date, {_lab(0)} AS test, {_lab(1)} AS loinc,
        CAST(value AS DECIMAL(10,2)) AS value, {_lab(2)} AS unit, {_lab(3)} AS low_text, {_lab(4)} AS high_text,
        CAST({_lab(3)} AS DECIMAL(10,3)) AS lo, CAST({_lab(4)} AS DECIMAL(10,3)) AS hi, event_type FROM events""",
    "f_labs": """SELECT *, CASE WHEN value < lo THEN 'Low' WHEN value > hi * 1.5 THEN 'Critical'
        WHEN value > hi THEN 'High' ELSE 'Normal' END AS flag FROM s_labs""",
    "v_labs": f"""SELECT s.lab_id AS "LabID", s.test AS "TestName", s.loinc AS "LOINCCode",
        CAST(s.value AS DECIMAL(10,3)) AS "ResultValue", s.unit AS "ResultUnit", s.lo AS "ReferenceRangeLow",
        s.hi AS "ReferenceRangeHigh", s.flag AS "AbnormalFlag",
        CAST(CAST(s.value AS DECIMAL(14,4)) - CAST(CAST(s.lo + s.hi AS DECIMAL(14,4)) * 0.5 AS DECIMAL(14,4))
            AS DECIMAL(14,4)) AS "DeviationFromMid",
        s.order_date AS "OrderDate", CAST(year(s.order_date) AS SMALLINT) AS "OrderYear",
        CAST(quarter(s.order_date) AS SMALLINT) AS "OrderQuarter", s.result_date AS "ResultDate",
        coalesce(p.id, {_UNKNOWN}) AS "PatientID", coalesce(p.name, 'Unknown Unknown') AS "PatientName",
        p.gender AS "Gender", CAST(year(s.order_date) - year(p.dob) AS INTEGER) AS "PatientAge",
        p.state AS "PatientState", coalesce(r.name, 'Unknown Unknown') AS "ProviderName",
        r.specialty AS "Specialty", coalesce(f.name, 'Unknown') AS "FacilityName",
        coalesce(f.type, 'Unknown') AS "FacilityType"
        FROM f_labs s LEFT JOIN d_patient p ON p.id = s.patient_id LEFT JOIN d_provider r ON r.id = s.provider_id
        LEFT JOIN d_facility f ON f.id = s.facility_id""",
    "s_rx": f"""SELECT 'R' || cid AS rx_id, 'C' || o_custkey AS patient_id, 'P' || l_suppkey AS provider_id,
        c_mktsegment AS payer_id, {listed([d[1] for d in ref.DRUGS[1:]] + ['None'])}[l_partkey % 11 + 1] AS code,
        CAST((l_linenumber % 3 + 1) * 30 AS SMALLINT) AS days, CAST(l_quantity AS SMALLINT) AS quantity,
        CAST(l_partkey % 12 AS SMALLINT) AS refills,
        CAST(l_partkey % 12 - (l_partkey % 12) // 2 AS SMALLINT) AS refills_left,
        odate AS prescribed, odate + CAST(l_linenumber % 7 AS INTEGER) AS filled,
        CAST(round(price * 0.001, 2) AS DECIMAL(10,2)) AS patient_cost,
        CAST(round(price * 0.005, 2) AS DECIMAL(10,2)) AS payer_cost FROM lines""",
    "f_rx": """SELECT * FROM s_rx QUALIFY row_number() OVER (PARTITION BY rx_id ORDER BY
        CAST(quantity AS VARCHAR) DESC, CAST(patient_cost AS VARCHAR) DESC, CAST(payer_cost AS VARCHAR) DESC) = 1""",
    "v_rx": f"""SELECT s.rx_id AS "PrescriptionID", s.days AS "DaysSupply", s.quantity AS "Quantity",
        s.refills AS "RefillsAuthorized", s.refills_left AS "RefillsRemaining", s.patient_cost AS "CostToPatient",
        s.payer_cost AS "CostToPayer", CAST(s.patient_cost + s.payer_cost AS DECIMAL(11,2)) AS "TotalCost",
        s.prescribed AS "PrescribedDate", CAST(year(s.prescribed) AS SMALLINT) AS "PrescribedYear",
        CAST(quarter(s.prescribed) AS SMALLINT) AS "PrescribedQuarter", s.filled AS "FillDate",
        coalesce(n.drug, 'Unknown') AS "DrugName", coalesce(n.code, 'UNKNOWN') AS "NDCCode", n.dosage AS "Dosage",
        n.frequency AS "Frequency", coalesce(p.id, {_UNKNOWN}) AS "PatientID",
        coalesce(p.name, 'Unknown Unknown') AS "PatientName", p.gender AS "Gender", p.state AS "PatientState",
        coalesce(r.name, 'Unknown Unknown') AS "ProviderName", r.specialty AS "Specialty",
        coalesce(y.name, 'Unknown') AS "PayerName", coalesce(y.type, 'Unknown') AS "PayerType", y.plan AS "PlanType"
        FROM f_rx s LEFT JOIN d_patient p ON p.id = s.patient_id LEFT JOIN d_provider r ON r.id = s.provider_id
        LEFT JOIN d_payer y ON y.id = s.payer_id LEFT JOIN ndc n ON n.code = s.code""",
    "s_fin": f"""SELECT *, {cased('kind', td.GL_ACCOUNTS)} AS gl FROM (
        SELECT 'T' || o_orderkey AS tx_id, CAST(o_orderdate AS DATE) AS day,
        {cased('o_orderpriority', td.TRANSACTION_TYPES)} AS kind,
        {listed(td.DEPARTMENTS)}[o_custkey % 15 + 1] AS department, 'F' || c_nationkey AS facility_id,
        CAST(o_totalprice AS DECIMAL(15,2)) AS amount, 'CC-' || (o_custkey % 900 + 100) AS cost_center
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "v_fin": """SELECT coalesce(f.name, 'Unknown') AS "FacilityName", coalesce(f.type, 'Unknown') AS "FacilityType",
        f.state AS "FacilityState", s.kind AS "TransactionType", s.department AS "Department", s.gl AS "GLAccount",
        CAST(year(s.day) AS SMALLINT) AS "FiscalYear", CAST(quarter(s.day) AS SMALLINT) AS "FiscalQuarter",
        monthname(s.day) AS "MonthName", CAST(month(s.day) AS SMALLINT) AS "MonthNumber",
        s.day AS "TransactionDate", s.amount AS "Amount", s.cost_center AS "CostCenter", s.facility_id AS facility_id
        FROM s_fin s LEFT JOIN d_facility f ON f.id = s.facility_id""",
    "v_perf": f"""SELECT "ProviderID", "ProviderName", "ProviderSpecialty" AS "Specialty",
        years_experience AS "YearsExperience", "FacilityName", "FacilityState", "ServiceYear", "ServiceQuarter",
        count(*) AS "TotalClaims", {total('"BilledAmount"')} AS "TotalBilled", {total('"PaidAmount"')} AS "TotalPaid",
        CAST(sum("BilledAmount") AS DOUBLE) / count(*) AS "AvgClaimValue",
        count(*) FILTER ("ClaimStatus" = 'Denied') AS "DeniedClaims",
        count(*) FILTER ("ClaimStatus" = 'Approved') AS "ApprovedClaims",
        CAST((count(*) FILTER ("ClaimStatus" = 'Denied') * 20000 + count(*)) // (2 * count(*)) AS DECIMAL(12,2)) / 100
            AS rate0 FROM v_claims GROUP BY ALL""",
    "v_performance": """SELECT * EXCLUDE (rate0), CAST(rate0 AS DECIMAL(5,2)) AS "DenialRatePct" FROM v_perf""",
    "usage": f"""SELECT event_id + 1 AS "LogID", {cased('event_type', td.EVENT_AGENTS)} AS "AgentName",
        'S' || user_id AS "SessionID", CAST(floor(value * 10) AS INTEGER) AS "InputTokens",
        CAST(floor(value) AS INTEGER) AS "OutputTokens",
        CASE WHEN event_id % 2 = 1 THEN CAST(floor(value) AS INTEGER) ELSE 0 END AS "CachedTokens",
        CAST(event_id % 5 AS INTEGER) AS "ToolCalls", CAST(NULL AS VARCHAR) AS "ModelID", ts AS "RequestTimestamp",
        CAST(NULL AS VARCHAR) AS "Notes" FROM events""",
    "answers": """SELECT vec_id AS id, 'Agent' || label AS agent, 'question ' || vec_id AS question,
        'answer ' || vec_id AS answer, embedding,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CASE vec_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 60 END)
            AS expires FROM embeddings WHERE vec_id % 10 <> 0""",
    "asked": """SELECT vec_id AS request_id, 'Agent' || label AS agent,
        'question ' || (vec_id + 1 + vec_id % 3) AS question, embedding FROM embeddings WHERE vec_id % 10 = 0""",
    "access_events": f"""SELECT event_id, {cased('event_type', td.EVENT_PRINCIPALS)} AS principal,
        {listed(td.AUDITED_OBJECTS)}[user_id % {len(td.AUDITED_OBJECTS)} + 1] AS object_name,
        CASE WHEN event_id % 20 = 0 THEN 'INSERT' ELSE 'SELECT' END AS permission FROM events""",
    "statements": "SELECT event_id, CASE event_type " + " ".join(
        f"WHEN {text(k)} THEN " + " || event_id || ".join(text(part) for part in v.split("{}"))
        for k, v in td.STATEMENTS.items()) + " END AS sql_text FROM events",
    "catalog": rows([(s, f"{s}.{o}") for s, names in ref.CATALOG.items() for o in names], "schema_name, object_name"),
    "grants": rows([(p, one, s) for p, many, s in ref.GRANTS for one in many.split()], "principal, permission, scope"),
    "denies": rows([(p, one, s) for p, many, s in ref.DENIES for one in many.split()], "principal, permission, scope"),
    "allowed_access": """SELECT g.principal, c.object_name, g.permission FROM grants g JOIN catalog c
        ON g.scope IN (c.schema_name, c.object_name)
        EXCEPT SELECT d.principal, c.object_name, d.permission FROM denies d JOIN catalog c
        ON d.scope IN (c.schema_name, c.object_name)""",
}

_ORDER = {name: i for i, name in enumerate(BLOCKS)}


def _mentioned(sql: str) -> set[str]:
    return {w for w in re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", sql)) if w in BLOCKS}


def q(body: str, recursive: bool = False) -> str:
    """The statement with the blocks it needs."""
    needed, open_names = set(), _mentioned(body)
    while open_names:
        name = open_names.pop()
        needed.add(name)
        open_names |= _mentioned(BLOCKS[name]) - needed - {name}
    if not needed:
        return body
    named = [f"{n} AS ({BLOCKS[n]})" for n in sorted(needed, key=_ORDER.get)]
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return "WITH " + ", ".join(named) + ", " + head[5:]
    return "WITH " + ", ".join(named) + " " + head
