"""Per-claim feature frame: claims enriched with patient and provider
attributes, rule flags and the ratio to the category mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import as_double, eq_flag, flag, safe_divisor
from claimspark.operators.outliers import group_mean, with_group_mean

PATIENT_COLUMNS, PROVIDER_COLUMNS = FV.PATIENT_COLUMNS, FV.PROVIDER_COLUMNS


def disease_means(claims: DataFrame, key: str = "disease_category",
                  out: str = "disease_avg_amount") -> DataFrame:
    """Mean claim amount per category (one row per category)."""
    return group_mean(claims, key, "claim_amount", out)


def claim_flags(claims: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Claims plus the derived columns that need nothing but the claim and the
    category means: claim_month, claim_year, cost_per_procedure,
    high_procedure, short_stay, suspicious_pattern, disease_avg_amount,
    inflation_ratio, is_inflated.

    The means (one row per category) are computed when this is called and
    left-joined, by broadcast if they are few.
    """
    means = means if means is not None else disease_means(claims)
    df = with_group_mean(claims, means, "disease_category", "disease_avg_amount")
    amount = as_double("claim_amount")
    return (df.select(
        *claims.columns,
        F.month("claim_date").alias("claim_month"),
        F.year("claim_date").alias("claim_year"),
        (amount / safe_divisor("num_procedures").cast("double")).alias("cost_per_procedure"),
        flag(F.col("num_procedures") >= FV.HIGH_PROCEDURE_MIN).alias("high_procedure"),
        flag(F.col("days_hospitalised") <= FV.SHORT_STAY_MAX).alias("short_stay"),
        "disease_avg_amount",
        (amount / F.col("disease_avg_amount")).alias("inflation_ratio"))
        .withColumn("suspicious_pattern", F.col("high_procedure").bitwiseAND(F.col("short_stay")))
        .withColumn("is_inflated", flag(F.col("inflation_ratio") > FV.INFLATED_RATIO)))


def claim_features(claims: DataFrame, patients: DataFrame, providers: DataFrame,
                   means: DataFrame | None = None) -> DataFrame:
    """One row per claim (left joins keep claims without a patient/provider).

    ``claim_flags`` plus patient and provider attributes and the two flags
    derived from them (kyc_risk, not_empanelled).  Flags treat a missing
    attribute as 0.  ``means`` defaults to the category means over all claims;
    pass a static table to use this on a stream or with train-only means.
    Analyses that need no patient or provider attribute should use
    ``claim_flags`` and skip both dimension joins.
    """
    flags = claim_flags(claims, means)
    df = (flags.join(patients.select(*PATIENT_COLUMNS), "patient_id", "left")
          .join(providers.select(*PROVIDER_COLUMNS), "provider_id", "left"))
    return df.select(
        *claims.columns, *PATIENT_COLUMNS[1:], *PROVIDER_COLUMNS[1:],
        "claim_month", "claim_year",
        eq_flag("kyc_verified", "No").alias("kyc_risk"),
        eq_flag("empanelled", "No").alias("not_empanelled"),
        "cost_per_procedure", "high_procedure", "short_stay", "suspicious_pattern",
        "disease_avg_amount", "inflation_ratio", "is_inflated")
