"""The whole analysis in one call: read the four tables, compute every result
table, write them out.

``run_report`` is the batch job a user runs instead of the single-machine
script: the eight rule/profile queries, the EDA tables behind every chart,
the risk tables, the model comparison and evaluation, and the two published
extracts (provider risk scores and the claim-level analysis, as CSV).  Every
result is a DataFrame written by the executors; only single totals and the
fitted models reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.operators import aggregates as agg
from claimspark.operators import evaluation as ev
from claimspark.operators import quality
from claimspark.plans import one_scan, profiles, rules
from claimspark.plans.features import claim_features, claim_flags
from claimspark.plans.models_full import FullModels, model_rows
from claimspark.schemas import FOREIGN_KEYS, PRIMARY_KEYS, TABLES
from claimspark.session import scratch
from claimspark.sources import readers, sinks

TABLE_NAMES = ("patients", "providers", "claims", "investigations")


def read_inputs(spark: SparkSession, input_dir: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """``{input_dir}/{name}.csv`` (or ``.parquet``) for the four tables, typed."""
    return {name: readers.read_table(spark, f"{input_dir.rstrip('/')}/{name}.{fmt}", TABLES[name], fmt)
            for name in TABLE_NAMES}


def result_tables(t: dict[str, DataFrame], with_models: bool = True,
                  trees: int = FV.FOREST_TREES, rounds: int = FV.BOOSTED_ROUNDS,
                  max_iter: int = FV.LOGISTIC_MAX_ITER) -> dict[str, DataFrame]:
    """Every result table of the analysis, keyed by output name (lazy where possible)."""
    c, p, v, inv = t["claims"], t["patients"], t["providers"], t["investigations"]
    flags = claim_flags(c)
    feats = claim_features(c, p, v)
    risk = profiles.risk_profile(c, "provider_id")
    out = {
        "q1_claim_inflation": rules.claim_inflation(c, p),
        "q2_duplicate_pairs": rules.duplicate_pairs(c, p),
        "q3_non_empanelled_high_value": rules.non_empanelled_high_value(c, p, v),
        "q4_procedure_burst": rules.procedure_burst(c, p),
        "q5_provider_rank": profiles.provider_rank(c, v),
        "q6_monthly_trend": profiles.monthly_trend(c),
        "q7_disease_profile": profiles.disease_profile(c),
        "q8_kyc_high_claims": rules.kyc_high_claims(c, p),
        "kpi_summary": profiles.kpi_summary(p, v, flags, inv),
        "eda_amount_hist": profiles.amount_histogram(c),
        "eda_fraud_type_counts": agg.value_counts(inv, "fraud_type"),
        "eda_ratio_hist": profiles.ratio_histogram(c),
        "eda_rate_by_policy": profiles.rate_by_patient_attribute(c, p, "policy_type"),
        "eda_recovered_by_status": agg.sum_by(inv, "status", "amount_recovered", "amount_recovered"),
        "provider_rate_hist": profiles.rate_histogram(risk),
        "provider_top_high": profiles.top_high_risk(risk),
        "dq_key_report": quality.key_report(t, PRIMARY_KEYS),
        "dq_orphan_report": quality.orphan_report(t, FOREIGN_KEYS),
    }
    out.update(one_scan.count_tables(c))
    if with_models:
        fm = FullModels(model_rows(feats), n_trees=trees, rounds=rounds, max_steps=max_iter).fit_all()
        boosted = fm.scored("boosted")
        out.update({
            "ml_compare": fm.comparison(),
            "ml_report_boosted": ev.classification_report(boosted, "label", "prediction"),
            "ml_confusion_boosted": ev.confusion_matrix(boosted, "label", "prediction"),
            "ml_importance_top": fm.importances(),
        })
        for name in ("logistic", "forest", "boosted"):
            out[f"ml_roc_{name}"] = ev.roc_points(fm.scored(name), "label", "probability")
    out["provider_risk"] = risk
    out["claim_extract"] = flags
    return out


def run_report(spark: SparkSession, t: dict[str, DataFrame], output_dir: str,
               with_models: bool = True, **model_args) -> list[str]:
    """Write every result table under ``output_dir``: the two published extracts
    as CSV with a header, everything else as Parquet.  Returns the names.  What was
    stored on the way is deleted."""
    base = output_dir.rstrip("/")
    with scratch(spark):
        tables = result_tables(t, with_models, **model_args)
        for name, df in tables.items():
            if name == "provider_risk":
                sinks.write_provider_risk(df, f"{base}/{name}")
            elif name == "claim_extract":
                sinks.write_claims_analysis(df, f"{base}/{name}")
            else:
                sinks.write_table(df.select([F.col(f"`{c}`") for c in df.columns]),
                                  f"{base}/{name}", "parquet")
    return list(tables)
