"""Grouped profiles: rates, counts, conditional sums and averages.

Every function is a single ``groupBy().agg()``: Spark runs a partial hash
aggregate before the shuffle (so a hot group sends one row per map task, not
its raw rows) and a final aggregate after it.  Sums of money are exact
(decimal) and only turned into doubles at the end, so results do not depend on
the order in which partitions are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions import as_double, band, pct, round_half_up, round_pct, round_ratio


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond) if cond is not None else df


def rate_by(df: DataFrame, key: str | Sequence[str], flag: str, out: str = "fraud_rate",
            with_band: bool = True, ascending: bool = True) -> DataFrame:
    """Percentage of rows with ``flag == 1`` per key (mean of a 0/1 flag x 100).

    Null keys are dropped (as a pandas group-by does).  Adds ``n`` (non-null
    flags) and, optionally, the severity ``band`` of the rate.
    """
    keys = _keys(key)
    res = (_not_null(df, keys).groupBy(*keys)
           .agg(F.count(flag).alias("n"), F.sum(flag).cast("bigint").alias("n_flagged"))
           .withColumn(out, pct("n_flagged", "n")))
    if with_band:
        res = res.withColumn("band", band(out))
    order = F.col(out).asc() if ascending else F.col(out).desc()
    return res.orderBy(order, *keys)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Row count and share (percent) of every class, largest class first.

    The share divides by the total over the aggregated table, which holds one
    row per class, so the un-partitioned window runs over a handful of rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return (counts.withColumn("share_pct", pct(F.col("n_rows"), total))
            .orderBy(F.col("n_rows").desc(), label))


def value_counts(df: DataFrame, col: str, out: str = "n_rows") -> DataFrame:
    """Count per non-null value, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), col))


def sum_by(df: DataFrame, key: str, value: str, out: str, ascending: bool = True) -> DataFrame:
    """Sum of ``value`` per non-null key, as double, sorted by the sum."""
    res = (_not_null(df, [key]).groupBy(key)
           .agg(as_double(F.sum(value)).alias(out)))
    return res.orderBy(F.col(out).asc() if ascending else F.col(out).desc(), key)


def monthly_counts(df: DataFrame, date_col: str, flag: str) -> DataFrame:
    """Per calendar month: rows with a flag, flagged rows, the rest and the rate.

    The month key is the first day of the month (a date), so it sorts and
    partitions like a date; rows with a null date are dropped.
    """
    month = F.trunc(F.col(date_col), "month")
    return (df.filter(F.col(date_col).isNotNull())
            .groupBy(month.alias("month_start"))
            .agg(F.count(flag).alias("total"), F.sum(flag).cast("bigint").alias("fraud"))
            .withColumn("legit", F.col("total") - F.col("fraud"))
            .withColumn("fraud_rate", pct("fraud", "total"))
            .orderBy("month_start"))


def period_profile(df: DataFrame, period: Column, period_name: str, flag: str, amount: str,
                   digits: int = 2) -> DataFrame:
    """Counts, flagged counts, flagged rate and flagged / total amounts per period.

    The flagged amount is ``sum(case when flag = 1 then amount else 0 end)``.
    ``amount`` is a DECIMAL of two places; sums and rates are rounded exactly.
    """
    return (df.groupBy(period.alias(period_name))
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 F.sum(flag).cast("bigint").alias("fraud_claims"),
                 F.sum(F.when(F.col(flag) == 1, F.col(amount)).otherwise(F.lit(0))).alias("_fraud_amount"),
                 F.sum(amount).alias("_total_amount"))
            .select(period_name, "total_claims", "fraud_claims",
                    round_pct("fraud_claims", "total_claims", digits).alias("fraud_rate_pct"),
                    round_half_up("_fraud_amount", digits).alias("fraud_amount"),
                    round_half_up("_total_amount", digits).alias("total_amount")))


def conditional_profile(df: DataFrame, key: str, amount: str, flag: str, digits: int = 2) -> DataFrame:
    """Per key: count, flagged count and rate, average amount, average flagged
    amount (null when nothing is flagged) and maximum amount.  ``amount`` is a
    DECIMAL of two places; all figures are rounded exactly."""
    flagged_amount = F.when(F.col(flag) == 1, F.col(amount))
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 F.sum(flag).cast("bigint").alias("fraud_count"),
                 F.sum(amount).alias("_sum"), F.count(amount).alias("_n"),
                 F.sum(flagged_amount).alias("_fsum"), F.count(flagged_amount).alias("_fn"),
                 F.max(amount).alias("_max"))
            .select(key, "total_claims", "fraud_count",
                    round_pct("fraud_count", "total_claims", digits).alias("fraud_rate_pct"),
                    round_ratio("_sum", "_n", digits).alias("avg_claim_amount"),
                    round_ratio("_fsum", "_fn", digits).alias("avg_fraud_amount"),
                    round_half_up("_max", digits).alias("max_claim_amount")))


def grid_counts(df: DataFrame, cols: Sequence[str], out: str = "n_rows") -> DataFrame:
    """Row count of every observed combination of ``cols`` (a scatter plot as a table)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))
