"""The five rule queries over claims, patients and providers.

The columns and order follow the named query; money and ratios are exact
DECIMALs.  Query 1 computes its table of category totals when it is called,
everything else is lazy.  Joins to the dimensions happen after the claims have been
filtered or aggregated, so the dimension join only sees the rows (or the
groups) that survive; dimension sides are never broadcast by hint because
they grow with the data — AQE broadcasts them only when their measured size
is below the threshold and otherwise plans a sort-merge join with skew
splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import round_half_up, round_ratio
from claimspark.operators.outliers import group_totals, ratio_outliers
from claimspark.operators.pairs import near_pairs
from claimspark.operators.semijoin import reduce_by_keys
from claimspark.operators.sweep import sweep_pairs
from claimspark.session import lookup_join


def claim_inflation(claims: DataFrame, patients: DataFrame, factor: float = FV.INFLATION_FACTOR,
                    key: str = "disease_category", means: DataFrame | None = None,
                    order: bool = True) -> DataFrame:
    """Query 1: claims whose amount is above ``factor`` x the mean of their category.

    By default everything is exact: ``amount * n > factor * sum`` decides, and
    mean and ratio are rounded from sum and count.  With ``means`` (key,
    avg_amount as double) the comparison and the ratio are in doubles.
    """
    rows = claims.select("claim_id", "patient_id", key, "claim_amount")
    if means is not None:
        flagged = ratio_outliers(rows, key, "claim_amount", factor, means=means)
        average, ratio = round_half_up("avg_amount"), round_half_up("ratio")
    else:
        scaled = F.col("claim_amount") * F.col("group_n")
        flagged = (lookup_join(rows, group_totals(claims, key, "claim_amount"), [key])
                   .filter(scaled > F.col("group_sum") * F.lit(factor)))
        average = round_ratio("group_sum", "group_n")
        ratio = round_ratio(scaled * 100, (F.col("group_sum") * 100).cast("decimal(38,0)"), places=0)
    out = (flagged.join(patients.select("patient_id", "name"), "patient_id", "inner")
           .select("claim_id", "patient_id", "name", key, "claim_amount",
                   average.alias("category_avg"), ratio.alias("inflation_ratio")))
    return out.orderBy(F.col("inflation_ratio").desc(), "claim_id") if order else out


def duplicate_pairs(claims: DataFrame, patients: DataFrame, symmetric: bool = False,
                    lo: int = FV.DUPLICATE_MIN_DAYS, hi: int = FV.DUPLICATE_MAX_DAYS,
                    bucketed: bool = True, order: bool = True, sweep: bool = False) -> DataFrame:
    """Query 2: two claims of one patient for one disease, ``lo..hi`` days apart.

    Directional by default (the claim with the smaller id must be the earlier
    one); ``symmetric=True`` accepts either order.  ``sweep=True`` finds the pairs
    by range partitions that exchange halos instead of a join of bucketed copies.
    """
    args = dict(lo=lo, hi=hi, carry=["claim_amount"], symmetric=symmetric)
    keys = ["patient_id", "disease_category"]
    pairs = (sweep_pairs(claims, keys, "claim_id", "claim_date", **args) if sweep
             else near_pairs(claims, keys, "claim_id", "claim_date", bucketed=bucketed, **args))
    out = (pairs.join(patients.select("patient_id", "name"), "patient_id", "inner")
           .select("patient_id", "name", "disease_category",
                   F.col("claim_id_1").alias("claim_1"), F.col("claim_id_2").alias("claim_2"),
                   "claim_amount_1", "claim_amount_2", "date_1", "date_2", "days_apart")
           .withColumnRenamed("claim_amount_1", "amount_1")
           .withColumnRenamed("claim_amount_2", "amount_2"))
    return out.orderBy("days_apart", "claim_1", "claim_2") if order else out


def non_empanelled_high_value(claims: DataFrame, patients: DataFrame, providers: DataFrame,
                              min_amount: float = FV.HIGH_VALUE_AMOUNT,
                              value: str = FV.NON_EMPANELLED_VALUE, order: bool = True) -> DataFrame:
    """Query 3: claims above ``min_amount`` billed by a non-approved provider."""
    prov = (providers.filter(F.col("empanelled") == F.lit(value))
            .select("provider_id", "hospital_name", "provider_type", "empanelled"))
    # Compared as decimal (exact, and pushed down to the Parquet scan).
    big = (claims.filter(F.col("claim_amount") > F.lit(min_amount))
           .select("claim_id", "patient_id", "provider_id", "claim_amount",
                   "disease_category", "claim_status"))
    out = (big.join(prov, "provider_id", "inner")
           .join(patients.select("patient_id", "name"), "patient_id", "inner")
           .select("claim_id", "patient_id", "name", "hospital_name", "provider_type", "empanelled",
                   "claim_amount", "disease_category", "claim_status"))
    return out.orderBy(F.col("claim_amount").desc(), "claim_id") if order else out


def procedure_burst(claims: DataFrame, patients: DataFrame,
                    min_procedures: int = FV.BURST_MIN_PROCEDURES,
                    max_days: int = FV.BURST_MAX_DAYS, order: bool = True) -> DataFrame:
    """Query 4: many procedures (>= 8) in a short stay (<= 2 days)."""
    hits = (claims.filter((F.col("num_procedures") >= min_procedures)
                          & (F.col("days_hospitalised") <= max_days))
            .select("claim_id", "patient_id", "disease_category", "num_procedures",
                    "days_hospitalised", "claim_amount"))
    out = (hits.join(patients.select("patient_id", "name"), "patient_id", "inner")
           .select("claim_id", "patient_id", "name", "disease_category", "num_procedures",
                   "days_hospitalised", round_half_up("claim_amount").alias("claim_amount"),
                   round_ratio("claim_amount", "num_procedures").alias("cost_per_procedure")))
    return out.orderBy(F.col("cost_per_procedure").desc(), "claim_id") if order else out


def kyc_high_claims(claims: DataFrame, patients: DataFrame,
                    min_total: float = FV.KYC_MIN_TOTAL,
                    value: str = FV.KYC_UNVERIFIED_VALUE, order: bool = True, reduce: bool = False) -> DataFrame:
    """Query 8: unverified patients whose claims total more than ``min_total``.

    Claims are aggregated per patient *before* the join (partial aggregation
    map-side, so a patient with a huge share of the claims costs one row per
    map task in the shuffle), and the HAVING filter is applied to the
    aggregates before they meet the patients.  ``reduce=True`` first keeps only claims
    of unverified patients (``reduce_by_keys``), so that the others' rows per
    patient are not shuffled either.
    """
    unverified = patients.filter(F.col("kyc_verified") == F.lit(value))
    if reduce:
        claims = reduce_by_keys(claims, "patient_id", unverified)
    per_patient = (claims.groupBy("patient_id")
                   .agg(F.count("claim_id").alias("total_claims"),
                        F.sum("claim_amount").alias("_total"),
                        F.sum("is_fraud").cast("bigint").alias("fraud_count"))
                   .withColumn("total_claimed", round_half_up("_total"))
                   .filter(F.col("total_claimed") > F.lit(min_total)))
    pats = unverified.select("patient_id", "name", "kyc_verified", "policy_type")
    out = (pats.join(per_patient, "patient_id", "inner")
           .select("patient_id", "name", "kyc_verified", "policy_type",
                   "total_claims", "total_claimed", "fraud_count"))
    return out.orderBy(F.col("total_claimed").desc(), "patient_id") if order else out
