"""The charts' count tables from one scan of the claims.

Class balance, rate by disease, monthly counts and the stay x procedure grid
all need the same two sums (rows with a label, flagged rows) over different
keys: GROUPING SETS computes them in one aggregate with map-side partial sums.
Its result has a row for each combination seen, and is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions import band, pct
from claimspark.session import stored

KEYS = ["is_fraud", "disease_category", "month_start", "days_hospitalised", "num_procedures"]
SETS = [["is_fraud"], ["disease_category"], ["month_start"], ["days_hospitalised", "num_procedures", "is_fraud"]]


def grouped(claims: DataFrame) -> DataFrame:
    """set_id (place in ``SETS``), the keys of all sets (null where not grouped by),
    n_rows, n_labelled and n_fraud."""
    keys = KEYS
    rows = claims.select(*[F.trunc("claim_date", "month").alias(k) if k == "month_start" else F.col(k) for k in keys],
                         F.col("is_fraud").alias("_label"))
    sums = rows.groupingSets([[F.col(k) for k in s] for s in SETS], *keys).agg(
        F.grouping_id(*keys).alias("_gid"), F.count(F.lit(1)).alias("n_rows"), F.count("_label").alias("n_labelled"),
        F.sum("_label").cast("bigint").alias("n_fraud"))
    ids = F.create_map(*[F.lit(x) for i, s in enumerate(SETS) for x in (
        sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s), i)])
    return sums.withColumn("set_id", ids[F.col("_gid").cast("int")]).drop("_gid")


def count_tables(claims: DataFrame) -> dict[str, DataFrame]:
    """``eda_class_balance``, ``eda_rate_by_disease``, ``eda_monthly`` and
    ``eda_stay_procedure_grid`` as the single operators give them."""
    sums = stored(grouped(claims), "grouping-sets")
    part = [sums.filter(F.col("set_id") == i) for i in range(len(SETS))]
    balance = part[0].select("is_fraud", "n_rows")
    total = balance.agg(F.sum("n_rows")).first()[0]
    return {
        "eda_class_balance": balance.withColumn("share_pct", pct(F.col("n_rows"), F.lit(total).cast("bigint")))
        .orderBy(F.col("n_rows").desc(), "is_fraud"),
        "eda_rate_by_disease": part[1].filter("disease_category IS NOT NULL")
        .select("disease_category", F.col("n_labelled").alias("n"), F.col("n_fraud").alias("n_flagged"))
        .withColumn("fraud_rate", pct("n_flagged", "n")).withColumn("band", band("fraud_rate"))
        .orderBy("fraud_rate", "disease_category"),
        "eda_monthly": part[2].filter("month_start IS NOT NULL")
        .select("month_start", F.col("n_labelled").alias("total"), F.col("n_fraud").alias("fraud"))
        .withColumn("legit", F.col("total") - F.col("fraud")).withColumn("fraud_rate", pct("fraud", "total")).orderBy("month_start"),
        "eda_stay_procedure_grid": part[3].select(*SETS[3], "n_rows"),
    }
