"""Profiles: provider rank, monthly trend, disease profile, EDA tables,
risk tiers and headline KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import as_double, band, mean_of, pct, round_half_up, round_pct, round_ratio, tier
from claimspark.operators import aggregates as agg
from claimspark.operators.histogram import histogram
from claimspark.operators.ranking import global_rank, top_k
from claimspark.plans.features import claim_flags
from claimspark.session import stored


def provider_stats(claims: DataFrame, providers: DataFrame, digits: int = 2) -> DataFrame:
    """Per provider: claims, fraud claims, billed total and mean, fraud rate.

    Claims are aggregated per provider first (partial aggregation before the
    shuffle) and only the per-provider rows meet the provider table.
    """
    per = (claims.groupBy("provider_id")
           .agg(F.count(F.lit(1)).alias("total_claims"),
                F.sum("is_fraud").cast("bigint").alias("fraud_claims"),
                F.sum("claim_amount").alias("_billed"),
                F.count("claim_amount").alias("_n")))
    return (per.join(providers.select("provider_id", "hospital_name", "provider_type"), "provider_id", "inner")
            .select("provider_id", "hospital_name", "provider_type", "total_claims", "fraud_claims",
                    round_half_up("_billed", digits).alias("total_billed"),
                    round_ratio("_billed", "_n", digits).alias("avg_claim"),
                    round_pct("fraud_claims", "total_claims", digits).alias("fraud_rate_pct")))


def provider_rank(claims: DataFrame, providers: DataFrame, min_claims: int = FV.RANK_MIN_CLAIMS,
                  limit: int = FV.RANK_LIMIT) -> DataFrame:
    """Query 5: providers ranked by fraud claims (``RANK()``, ties share a rank),
    rank taken over *all* providers, then ``total_claims >= min_claims``, first
    ``limit`` by rank (provider id breaks ties).

    The ``limit`` rows are picked with a distributed top-k and looked up in the
    table of ranks, one row per fraud-claim count — no sort of the whole
    provider table into one task.  The per-provider table (one row per
    provider) is stored, so the claims are aggregated once for both.
    """
    stats = stored(provider_stats(claims, providers), "provider-stats")
    candidates = top_k(stats.filter(F.col("total_claims") >= min_claims),
                       [F.col("fraud_claims").desc(), F.col("provider_id").asc()], limit)
    ranked = global_rank(candidates, "fraud_claims", out="fraud_rank", population=stats)
    return (ranked.select("provider_id", "hospital_name", "provider_type", "total_claims",
                          "fraud_claims", "total_billed", "avg_claim", "fraud_rate_pct", "fraud_rank")
            .orderBy("fraud_rank", "provider_id"))


def provider_fraud_ranks(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Every provider with its fraud claims and their ``RANK()``, largest first."""
    stats = stored(provider_stats(claims, providers).select("provider_id", "fraud_claims"), "provider-frauds")
    return global_rank(stats, "fraud_claims", out="fraud_rank").select("provider_id", "fraud_claims", "fraud_rank")


def monthly_trend(claims: DataFrame) -> DataFrame:
    """Query 6: per ``yyyy-MM`` month: claims, fraud claims, rate, fraud and total amounts."""
    month = F.date_format("claim_date", FV.MONTH_FORMAT)
    return agg.period_profile(claims, month, "month", "is_fraud", "claim_amount").orderBy("month")


def disease_profile(claims: DataFrame) -> DataFrame:
    """Query 7: per disease: claims, frauds, rate, mean / mean fraud / max amount."""
    return (agg.conditional_profile(claims, "disease_category", "claim_amount", "is_fraud")
            .orderBy(F.col("fraud_rate_pct").desc(), "disease_category"))


def risk_profile(features: DataFrame, key: str = "provider_id", min_claims: int = FV.RISK_MIN_CLAIMS,
                 edges=FV.RISK_TIER_EDGES, labels=FV.RISK_TIER_LABELS) -> DataFrame:
    """Risk table per ``key``: claims, fraud claims, billed total and mean,
    unrounded fraud rate (``fraud / total * 100``), support filter and the
    right-closed risk tier (LOW / MEDIUM / HIGH).

    Needs only ``key, claim_id, is_fraud, claim_amount``: pass the claims
    table itself (no dimension joins) when the key is a claim column."""
    per = (features.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count("claim_id").alias("total_claims"),
                F.sum("is_fraud").cast("bigint").alias("fraud_claims"),
                F.sum("claim_amount").alias("_billed"),
                F.count("claim_amount").alias("_n")))
    rate = (F.col("fraud_claims").cast("double") / F.col("total_claims").cast("double")) * F.lit(100.0)
    return (per.filter(F.col("total_claims") >= min_claims)
            .select(key, "total_claims", "fraud_claims",
                    as_double("_billed").alias("total_billed"),
                    mean_of("_billed", "_n").alias("avg_claim"),
                    rate.alias("fraud_rate"))
            .withColumn("risk_tier", tier("fraud_rate", edges, labels)))


def rate_by_patient_attribute(claims: DataFrame, patients: DataFrame, attribute: str,
                              flag: str = "is_fraud", out: str = "fraud_rate") -> DataFrame:
    """``rate_by`` over an attribute of the patient (e.g. policy type).

    Claims are first reduced to one row per patient (flag count and sum,
    partial aggregation before the shuffle), so only those rows meet the
    patient table; claims without a patient have no attribute and drop out,
    as null keys do in ``rate_by``.
    """
    per_patient = (claims.groupBy("patient_id")
                   .agg(F.count(flag).alias("_n"), F.sum(flag).alias("_f")))
    joined = per_patient.join(patients.select("patient_id", attribute), "patient_id", "inner")
    res = (joined.filter(F.col(attribute).isNotNull()).groupBy(attribute)
           .agg(F.sum("_n").cast("bigint").alias("n"), F.sum("_f").cast("bigint").alias("n_flagged"))
           .withColumn(out, pct("n_flagged", "n"))
           .withColumn("band", band(out)))
    return res.orderBy(F.col(out).asc(), attribute)


def top_high_risk(risk: DataFrame, key: str = "provider_id", k: int = FV.TOP_HIGH_RISK) -> DataFrame:
    """The ``k`` HIGH-tier rows with the largest fraud rate (key breaks ties)."""
    return top_k(risk.filter(F.col("risk_tier") == "HIGH"),
                 [F.col("fraud_rate").desc(), F.col(key).asc()], k)


def tier_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("risk_tier")


def rate_histogram(risk: DataFrame, bins: int = FV.PROVIDER_RATE_HIST_BINS) -> DataFrame:
    """Count histogram of the fraud rate of a risk table.  The risk table (one
    row per provider) is stored so the claims are aggregated once for
    both passes of the histogram (range, then bins)."""
    return histogram(stored(risk.select("fraud_rate"), "risk-rates"), "fraud_rate", bins)


def amount_histogram(claims: DataFrame, bins: int = FV.AMOUNT_HIST_BINS) -> DataFrame:
    return histogram(claims, "claim_amount", bins, by="is_fraud", density=True)


def ratio_histogram(claims: DataFrame, bins: int = FV.RATIO_HIST_BINS, by: str = "is_fraud") -> DataFrame:
    """Density of the ratio of a claim to its category's mean, per class, in two
    passes over the claims: sums, counts and extremes per (category, class) give
    both the means and the range of the ratios; the second pass bins them."""
    key, x = "disease_category", F.col("claim_amount")
    parts = stored(claims.filter(F.col(key).isNotNull()).groupBy(key, by).agg(
        F.sum(x).alias("s"), F.count(x).alias("n"), as_double(F.min(x)).alias("lo"), as_double(F.max(x)).alias("hi")), "ratio-parts")
    means = stored(parts.groupBy(key).agg(mean_of(F.sum("s"), F.sum("n")).alias("disease_avg_amount")), "ratio-means")
    ends = parts.join(means, key).filter(F.col(by).isNotNull()).withColumns(
        {e: F.col(e) / F.col("disease_avg_amount") for e in ("lo", "hi")})
    ranges = ends.groupBy(by).agg(F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi"),
                                  F.sum("n").alias("total"))
    return histogram(claim_flags(claims.select(*claims.columns), means), "inflation_ratio", bins, by=by, density=True,
                     ranges=ranges)


def stay_procedure_grid(claims: DataFrame) -> DataFrame:
    return agg.grid_counts(claims, ["days_hospitalised", "num_procedures", "is_fraud"])


def kpi_summary(patients: DataFrame, providers: DataFrame, features: DataFrame,
                investigations: DataFrame) -> DataFrame:
    """One row of headline figures.

    Each table is aggregated on its own into one row; the four rows (each
    filling only its own columns) are stacked and collapsed by one more global
    aggregate — no joins.  ``features`` needs only is_fraud, is_inflated and
    suspicious_pattern (``claim_flags`` is enough).
    """
    p = patients.agg(F.count(F.lit(1)).alias("n_patients"))
    v = providers.agg(F.count(F.lit(1)).alias("n_providers"))
    c = features.agg(F.count(F.lit(1)).alias("n_claims"),
                     F.sum("is_fraud").cast("bigint").alias("fraud_claims"),
                     F.count("is_fraud").alias("_nf"),
                     F.sum("is_inflated").cast("bigint").alias("inflated_claims"),
                     F.sum("suspicious_pattern").cast("bigint").alias("suspicious_claims"))
    i = investigations.agg(F.count(F.lit(1)).alias("n_investigations"),
                           as_double(F.sum("amount_recovered")).alias("amount_recovered"))
    stacked = (p.unionByName(v, allowMissingColumns=True)
               .unionByName(c, allowMissingColumns=True)
               .unionByName(i, allowMissingColumns=True))
    cols = ["n_patients", "n_providers", "n_claims", "n_investigations", "fraud_claims", "_nf",
            "inflated_claims", "suspicious_claims", "amount_recovered"]
    one = stacked.agg(*[F.max(x).alias(x) for x in cols])
    return one.select("n_patients", "n_providers", "n_claims", "n_investigations", "fraud_claims",
                      pct("fraud_claims", "_nf").alias("fraud_rate_pct"),
                      "inflated_claims", "suspicious_claims", "amount_recovered")
