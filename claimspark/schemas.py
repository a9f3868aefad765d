"""Typed schemas of the claims data model and of the two published outputs.

FIXED VALUES: the column names, types and keys are those of the data model.
Ids are strings there; the testdata mapping produces
integer patient/provider ids, which every operator accepts because the
operators take column names, not types.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

PATIENTS = T.StructType([
    T.StructField("patient_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("policy_type", T.StringType()),
    T.StructField("premium_tier", T.StringType()),
    T.StructField("policy_start", T.DateType()),
    T.StructField("kyc_verified", T.StringType()),
])

PROVIDERS = T.StructType([
    T.StructField("provider_id", T.StringType(), False),
    T.StructField("hospital_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("provider_type", T.StringType()),
    T.StructField("empanelled", T.StringType()),
])

CLAIMS = T.StructType([
    T.StructField("claim_id", T.StringType(), False),
    T.StructField("patient_id", T.StringType()),
    T.StructField("provider_id", T.StringType()),
    T.StructField("disease_category", T.StringType()),
    T.StructField("claim_amount", MONEY),
    T.StructField("days_hospitalised", T.IntegerType()),
    T.StructField("num_procedures", T.IntegerType()),
    T.StructField("claim_date", T.DateType()),
    T.StructField("duplicate_claim", T.IntegerType()),
    T.StructField("empanelled_provider", T.IntegerType()),
    T.StructField("claim_status", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
])

INVESTIGATIONS = T.StructType([
    T.StructField("investigation_id", T.StringType(), False),
    T.StructField("claim_id", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("fraud_type", T.StringType()),
    T.StructField("investigation_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("amount_recovered", MONEY),
])

PROVIDER_RISK = T.StructType([
    T.StructField("provider_id", T.StringType()),
    T.StructField("total_claims", T.LongType()),
    T.StructField("fraud_claims", T.LongType()),
    T.StructField("total_billed", T.DoubleType()),
    T.StructField("avg_claim", T.DoubleType()),
    T.StructField("fraud_rate", T.DoubleType()),
    T.StructField("risk_tier", T.StringType()),
])

# Columns of the claim-level extract handed to the BI tool.
CLAIMS_ANALYSIS_COLUMNS = [
    "claim_id", "patient_id", "provider_id", "disease_category", "claim_amount",
    "days_hospitalised", "num_procedures", "is_fraud", "inflation_ratio",
    "suspicious_pattern", "duplicate_claim",
]

TABLES = {
    "patients": PATIENTS,
    "providers": PROVIDERS,
    "claims": CLAIMS,
    "investigations": INVESTIGATIONS,
}

PRIMARY_KEYS = {
    "patients": ["patient_id"],
    "providers": ["provider_id"],
    "claims": ["claim_id"],
    "investigations": ["investigation_id"],
}

# (child table, child key, parent table, parent key)
FOREIGN_KEYS = [
    ("claims", "patient_id", "patients", "patient_id"),
    ("claims", "provider_id", "providers", "provider_id"),
    ("investigations", "claim_id", "claims", "claim_id"),
    ("investigations", "patient_id", "patients", "patient_id"),
]
