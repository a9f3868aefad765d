"""Values far above the mean of their group (claim inflation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import as_double, mean_of
from claimspark.session import lookup_join


def group_mean(df: DataFrame, key: str, value: str, out: str = "avg_amount") -> DataFrame:
    """Mean of ``value`` per ``key`` (null values skipped, null keys dropped).

    The exact sum (decimal/integer) is divided by the non-null count, so the
    mean is the same double in every engine.  One partial + final hash
    aggregate; the result has one row per group.
    """
    return (df.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(mean_of(F.sum(value), F.count(value)).alias(out)))


def group_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact ``group_sum`` and ``group_n`` of the non-null values per non-null key."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum(value).alias("group_sum"), F.count(value).alias("group_n")))


def with_group_mean(df: DataFrame, means: DataFrame, key: str, avg_col: str, how: str = "left") -> DataFrame:
    """``df`` with ``avg_col`` of its group.  A key that ``means`` repeats counts
    once, with its largest mean."""
    return lookup_join(df, means.groupBy(key).agg(F.max(avg_col).alias(avg_col)), [key], how)


def ratio_outliers(df: DataFrame, key: str, value: str, factor: float = FV.INFLATION_FACTOR,
                   avg_col: str = "avg_amount", ratio_col: str = "ratio",
                   means: DataFrame | None = None) -> DataFrame:
    """Rows whose ``value`` is strictly above ``factor`` x the mean of their group.

    Adds the group mean ``avg_col`` and ``ratio_col = value / mean``.  ``means``
    may be supplied (e.g. computed on a training subset); by default it is the
    mean over ``df`` itself.
    """
    means = means if means is not None else group_mean(df, key, value, avg_col)
    amount = as_double(value)
    staged = with_group_mean(df, means.select(key, avg_col), key, avg_col, "inner")
    return (staged.filter(amount > F.col(avg_col) * F.lit(float(factor)))
            .withColumn(ratio_col, amount / F.col(avg_col)))
