"""Fixed values the warehouse is defined with.

Everything below is a constant of the data model: code lists, unknown
members, configured budgets, access policy.  All lists are short and fixed,
so the tables built from them may be broadcast.
"""

# --- fixed values: unknown members -----------------------------------------
UNKNOWN_ID = "00000000-0000-0000-0000-000000000000"
UNKNOWN_CODE = "UNKNOWN"
UNKNOWN_KEY = 1
UNKNOWN_DATE_KEY = 0
UNKNOWN_DATE = "1900-01-01"

# --- fixed values: ICD-10 diagnosis codes ----------------------------------
DIAGNOSES = [
    ("UNKNOWN", "Unknown / Not Coded"),
    ("E11.9", "Type 2 diabetes mellitus without complications"),
    ("I10", "Essential (primary) hypertension"),
    ("J45.909", "Unspecified asthma, uncomplicated"),
    ("M54.5", "Low back pain"),
    ("F41.1", "Generalized anxiety disorder"),
    ("K21.0", "GERD with esophagitis"),
    ("E78.5", "Hyperlipidemia, unspecified"),
    ("N39.0", "Urinary tract infection"),
    ("J06.9", "Acute upper respiratory infection"),
    ("Z00.00", "General adult medical exam without abnormal findings"),
    ("I25.10", "Atherosclerotic heart disease, unspecified"),
    ("F32.9", "Major depressive disorder, single episode"),
    ("J18.9", "Pneumonia, unspecified organism"),
    ("K92.1", "Melena"),
    ("R51", "Headache"),
]

# --- fixed values: CPT procedure codes with base price ---------------------
PROCEDURES = [
    ("UNKNOWN", "Unknown / Not Coded", "0.00"),
    ("99213", "Office visit, established patient, low-moderate complexity", "150.00"),
    ("99214", "Office visit, established patient, moderate-high complexity", "250.00"),
    ("99215", "Office visit, established patient, high complexity", "350.00"),
    ("99203", "Office visit, new patient, moderate complexity", "200.00"),
    ("99204", "Office visit, new patient, moderate-high complexity", "300.00"),
    ("93000", "Electrocardiogram (ECG/EKG)", "75.00"),
    ("80053", "Comprehensive metabolic panel", "85.00"),
    ("85025", "Complete blood count (CBC)", "60.00"),
    ("71046", "Chest X-ray, 2 views", "120.00"),
    ("99285", "Emergency department visit, high complexity", "650.00"),
]

# --- fixed values: drugs (name, NDC, dosage, frequency) --------------------
DRUGS = [
    ("Unknown", "UNKNOWN", None, None),
    ("Metformin", "00093-1048-01", "500mg", "Twice daily"),
    ("Lisinopril", "00093-1046-01", "10mg", "Once daily"),
    ("Atorvastatin", "00069-0155-30", "20mg", "Once daily at bedtime"),
    ("Amlodipine", "00069-1540-30", "5mg", "Once daily"),
    ("Omeprazole", "00093-7366-56", "20mg", "Once daily before meal"),
    ("Levothyroxine", "00074-4137-13", "50mcg", "Once daily"),
    ("Sertraline", "00049-4900-66", "50mg", "Once daily"),
    ("Albuterol", "00173-0682-20", "90mcg", "Every 4-6 hours as needed"),
    ("Gabapentin", "00093-0636-56", "300mg", "Three times daily"),
    ("Amoxicillin", "00093-4159-01", "500mg", "Every 8 hours"),
]

# --- fixed values: age bands ------------------------------------------------
AGE_LIMITS = (18, 35, 50, 65)
AGE_BANDS = ("0–18", "19–35", "36–50", "51–65", "65+")
AGE_BANDS_NUMBERED = ("1. 0-18", "2. 19-35", "3. 36-50", "4. 51-65", "5. 65+")

# --- fixed values: agents (name, login, token budget, cache minutes) --------
AGENTS = [
    ("OrchestratorAgent", "agent_orchestrator", 150_000, 30),
    ("ClaimsAgent", "agent_claims", 500_000, 30),
    ("ClinicalAgent", "agent_clinical", 500_000, 15),
    ("FinancialAgent", "agent_financial", 500_000, 60),
    ("ReportingAgent", "agent_reporting", 500_000, 60),
    ("ETLAgent", "agent_etl", 300_000, 15),
    ("ProviderAgent", "agent_provider", 500_000, 30),
]
DEFAULT_TOKEN_BUDGET = 20_000
MIN_TOKENS_LEFT = 2_000
DEFAULT_CACHE_MINUTES = 30
SIMILARITY_FLOOR = 0.75
CACHED_QUERY_CHARS = 2_000

# --- fixed values: objects of the warehouse, by schema ----------------------
CATALOG = {
    "stg": ["Payers", "Facilities", "Providers", "Patients", "Claims", "Labs",
            "Prescriptions", "Financials"],
    "dw": ["DimDate", "DimPayer", "DimFacility", "DimProvider", "DimPatient",
           "DimDiagnosis", "DimProcedure", "DimDrug", "FactClaims",
           "FactLabResults", "FactPrescriptions", "FactFinancials", "ETLLog",
           "AgentUsageLog", "QueryCache", "usp_GetClaimsSummary",
           "usp_GetFinancialYoY", "usp_GetProviderPerformance",
           "usp_GetAbnormalLabResults", "usp_GetPatientTimeline",
           "usp_GetAgentUsage", "usp_ETL_RunAll", "usp_ETL_LoadDimPayer",
           "usp_ETL_LoadDimFacility", "usp_ETL_LoadDimProvider",
           "usp_ETL_LoadDimPatient", "usp_ETL_LoadFactClaims",
           "usp_ETL_LoadFactLabResults", "usp_ETL_LoadFactPrescriptions",
           "usp_ETL_LoadFactFinancials"],
    "rpt": ["vw_ClaimsSummary", "vw_FinancialKPIs", "vw_LabResults",
            "vw_Prescriptions", "vw_ProviderPerformance", "vw_AgentUsage"],
}

# --- fixed values: grants (principal, permissions, schema or object) --------
# A scope without a dot is a whole schema.
GRANTS = [
    ("agent_orchestrator", "SELECT", "rpt"),
    ("agent_orchestrator", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_orchestrator", "SELECT INSERT DELETE", "dw.QueryCache"),
    ("agent_orchestrator", "SELECT", "rpt.vw_AgentUsage"),
    ("agent_orchestrator", "EXECUTE", "dw.usp_GetAgentUsage"),
    ("agent_claims", "SELECT", "rpt"),
    ("agent_claims", "SELECT", "dw.FactClaims"),
    ("agent_claims", "SELECT", "dw.DimPatient"),
    ("agent_claims", "SELECT", "dw.DimProvider"),
    ("agent_claims", "SELECT", "dw.DimPayer"),
    ("agent_claims", "SELECT", "dw.DimFacility"),
    ("agent_claims", "SELECT", "dw.DimDiagnosis"),
    ("agent_claims", "SELECT", "dw.DimProcedure"),
    ("agent_claims", "SELECT", "dw.DimDate"),
    ("agent_claims", "EXECUTE", "dw.usp_GetClaimsSummary"),
    ("agent_claims", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_clinical", "SELECT", "rpt"),
    ("agent_clinical", "SELECT", "dw.FactLabResults"),
    ("agent_clinical", "SELECT", "dw.FactPrescriptions"),
    ("agent_clinical", "SELECT", "dw.DimPatient"),
    ("agent_clinical", "SELECT", "dw.DimDrug"),
    ("agent_clinical", "SELECT", "dw.DimDiagnosis"),
    ("agent_clinical", "SELECT", "dw.DimProvider"),
    ("agent_clinical", "SELECT", "dw.DimDate"),
    ("agent_clinical", "EXECUTE", "dw.usp_GetAbnormalLabResults"),
    ("agent_clinical", "EXECUTE", "dw.usp_GetPatientTimeline"),
    ("agent_clinical", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_financial", "SELECT", "rpt"),
    ("agent_financial", "SELECT", "dw.FactFinancials"),
    ("agent_financial", "SELECT", "dw.DimFacility"),
    ("agent_financial", "SELECT", "dw.DimDate"),
    ("agent_financial", "EXECUTE", "dw.usp_GetFinancialYoY"),
    ("agent_financial", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_reporting", "SELECT", "rpt"),
    ("agent_reporting", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_reporting", "SELECT", "rpt.vw_AgentUsage"),
    ("agent_reporting", "EXECUTE", "dw.usp_GetAgentUsage"),
    ("agent_etl", "SELECT INSERT UPDATE DELETE", "stg"),
    ("agent_etl", "INSERT", "dw.ETLLog"),
    ("agent_etl", "SELECT", "dw"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_RunAll"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadDimPayer"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadDimFacility"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadDimProvider"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadDimPatient"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadFactClaims"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadFactLabResults"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadFactPrescriptions"),
    ("agent_etl", "EXECUTE", "dw.usp_ETL_LoadFactFinancials"),
    ("agent_etl", "SELECT INSERT", "dw.AgentUsageLog"),
    ("agent_provider", "SELECT", "rpt"),
    ("agent_provider", "SELECT", "dw.DimProvider"),
    ("agent_provider", "SELECT", "dw.DimFacility"),
    ("agent_provider", "SELECT", "dw.FactClaims"),
    ("agent_provider", "SELECT", "dw.DimDate"),
    ("agent_provider", "SELECT", "dw.DimPatient"),
    ("agent_provider", "SELECT", "dw.DimDiagnosis"),
    ("agent_provider", "SELECT", "dw.DimProcedure"),
    ("agent_provider", "EXECUTE", "dw.usp_GetProviderPerformance"),
    ("agent_provider", "SELECT INSERT", "dw.AgentUsageLog"),
]

# --- fixed values: denies (principal, permissions, schema or object) --------
DENIES = [
    ("agent_orchestrator", "SELECT", "stg"),
    ("agent_claims", "SELECT", "stg"),
    ("agent_clinical", "SELECT", "stg"),
    ("agent_clinical", "SELECT", "dw.FactFinancials"),
    ("agent_financial", "SELECT", "stg"),
    ("agent_financial", "SELECT", "dw.FactClaims"),
    ("agent_financial", "SELECT", "dw.FactLabResults"),
    ("agent_financial", "SELECT", "dw.FactPrescriptions"),
    ("agent_financial", "SELECT", "dw.DimPatient"),
    ("agent_reporting", "SELECT", "stg"),
    ("agent_provider", "SELECT", "stg"),
    ("agent_provider", "SELECT", "dw.FactFinancials"),
    ("agent_provider", "SELECT", "dw.FactLabResults"),
    ("agent_provider", "SELECT", "dw.FactPrescriptions"),
]

# --- fixed values: column descriptions ---------------------------------------
COLUMN_DESCRIPTIONS = {
    "BilledAmount": "Amount billed by provider to payer",
    "AllowedAmount": "Amount allowed by payer contract",
    "PaidAmount": "Amount actually paid by payer",
    "WriteOffAmount": "Contractual write-off (AllowedAmount minus PaidAmount)",
    "CostToPatient": "Patient out-of-pocket cost (copay/deductible)",
    "CostToPayer": "Amount covered by the payer",
    "TotalCost": "Total cost (CostToPatient + CostToPayer)",
    "ClaimStatus": "Approved | Denied | Pending | Appealed",
    "AbnormalFlag": "Normal | High | Low | Critical",
    "DenialRatePct": "Percentage of claims denied for a provider",
    "PatientAgeAtService": "Age of patient at time of service (years)",
    "FiscalYear": "Fiscal year (same as calendar year in this dataset)",
    "FiscalQuarter": "Fiscal quarter (Q1–Q4)",
    "IsCurrent": "SCD2 flag — 1 = current record, 0 = historical",
    "IsWeekend": "1 = Saturday or Sunday",
    "DaysSupply": "Number of days a prescription covers",
    "RefillsAuthorized": "Total refills authorized by the prescriber",
    "RefillsRemaining": "Refills remaining on the prescription",
    "TransactionType": "Revenue | Expense (FactFinancials)",
    "Department": "Clinical or administrative department name",
    "Amount": "Financial transaction amount",
}
