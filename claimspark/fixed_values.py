"""Fixed values.

These numbers and labels must equal the ones of the analysis this library
reproduces, or results differ.  They are kept together here, in the order in
which the analysis uses them, and every operator takes them as defaults only.
"""

# FIXED VALUES — rule queries
INFLATION_FACTOR = 2                 # claim amount > 2 x group mean
DUPLICATE_MIN_DAYS = 1               # pair of claims at least 1 day apart ...
DUPLICATE_MAX_DAYS = 30              # ... and at most 30 days apart
NON_EMPANELLED_VALUE = "No"          # providers.empanelled value of an unapproved provider
HIGH_VALUE_AMOUNT = 50000            # claim amount > 50,000
BURST_MIN_PROCEDURES = 8             # num_procedures >= 8 ...
BURST_MAX_DAYS = 2                   # ... and days_hospitalised <= 2
RANK_MIN_CLAIMS = 10                 # provider rank: keep total_claims >= 10
RANK_LIMIT = 20                      # provider rank: first 20
KYC_UNVERIFIED_VALUE = "No"          # patients.kyc_verified value of an unverified patient
KYC_MIN_TOTAL = 100000               # unverified patients with total claimed > 100,000
MONTH_FORMAT = "yyyy-MM"             # month key of the monthly trend

# FIXED VALUES — per-claim features
PATIENT_COLUMNS = ["patient_id", "age", "gender", "policy_type", "premium_tier", "kyc_verified"]
PROVIDER_COLUMNS = ["provider_id", "provider_type", "empanelled"]
HIGH_PROCEDURE_MIN = 8               # high_procedure: num_procedures >= 8
SHORT_STAY_MAX = 2                   # short_stay: days_hospitalised <= 2
INFLATED_RATIO = 2                   # is_inflated: inflation_ratio > 2
UNKNOWN_LABEL = "Unknown"            # fill value of missing categorical labels

# FIXED VALUES — profiles and charts
BAND_DANGER_ABOVE = 12               # rate > 12 -> "danger"
BAND_WARNING_ABOVE = 8               # rate > 8  -> "warning", else "ok"
AMOUNT_HIST_BINS = 40                # claim amount histogram, per class
RATIO_HIST_BINS = 30                 # inflation ratio histogram, per class
PROVIDER_RATE_HIST_BINS = 20         # provider fraud rate histogram
RISK_MIN_CLAIMS = 5                  # provider risk: keep total_claims >= 5
RISK_TIER_EDGES = [-1, 8, 18, 101]   # right-closed bins (-1,8], (8,18], (18,101]
RISK_TIER_LABELS = ["LOW", "MEDIUM", "HIGH"]
TOP_HIGH_RISK = 15                   # top 15 HIGH-tier providers by fraud rate
TOP_IMPORTANCES = 12                 # top 12 feature importances

# FIXED VALUES — model features (15 numeric, then 5 encoded categoricals)
NUMERIC_FEATURES = [
    "claim_amount", "days_hospitalised", "num_procedures", "duplicate_claim",
    "empanelled_provider", "kyc_risk", "not_empanelled", "cost_per_procedure",
    "high_procedure", "short_stay", "suspicious_pattern", "inflation_ratio",
    "is_inflated", "age", "claim_month",
]
CATEGORICAL_FEATURES = [
    ("disease_category", "disease_enc"),
    ("gender", "gender_enc"),
    ("policy_type", "policy_enc"),
    ("premium_tier", "premium_enc"),
    ("provider_type", "provtype_enc"),
]
LABEL = "is_fraud"
TEST_FRACTION = 0.2
SPLIT_SEED = 42
LOGISTIC_MAX_ITER = 500
FOREST_TREES = 100
BOOSTED_ROUNDS = 100

# Parameters of this library's own
FOREST_MAX_DEPTH = 30                # as deep as Spark's trees go
MAX_TRAIN_ROWS = 200_000             # about so many training rows are fitted on; all test rows are scored
SAMPLE_SEED = 7                      # hash seed that picks them

# FIXED VALUES — investigations
INVESTIGATED_FRACTION = 0.75
RECOVERY_LOW = 0.4
RECOVERY_HIGH = 0.9
INVESTIGATION_ID_FORMAT = "INV%05d"
FRAUD_TYPES = [
    "Claim Inflation", "Duplicate Claim", "Non-Empanelled Provider",
    "Unnecessary Procedures", "Falsified Documents",
]
INVESTIGATION_STATUSES = ["Confirmed Fraud", "Confirmed Fraud", "Under Review", "Dismissed"]
