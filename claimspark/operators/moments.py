"""Means and deviations of whole tables, and scaling by them.

Sums and sums of squares are added as decimals of ``PLACES`` digits after the
point, so they are exact, mergeable and the same however the rows are
partitioned: one aggregate with map-side partial sums, one row to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values are rounded to so many digits after the point before they are added.
PLACES = 6
_EXACT = Context(prec=120)


@dataclass(frozen=True)
class Moments:
    """Rows, mean and population deviation of each column, as scikit-learn's scaler has them."""

    names: list[str]
    n: int
    mean: list[float]
    deviation: list[float]

    def scaled(self, name: str) -> Column:
        """(x - mean) / deviation; a constant column becomes 0."""
        i = self.names.index(name)
        return (F.col(f"`{name}`").cast("double") - F.lit(self.mean[i])) / F.lit(self.deviation[i] or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with every measured column scaled in place."""
        return df.withColumns({c: self.scaled(c) for c in self.names})

    def table(self, df: DataFrame) -> DataFrame:
        """feature, n_rows, mean, deviation: a row for each column (bounded by the columns)."""
        rows = list(zip(self.names, [self.n] * len(self.names), self.mean, self.deviation))
        return df.sparkSession.createDataFrame(rows, "feature string, n_rows bigint, mean double, deviation double")


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """One pass over ``df``; nulls are left out of a column's sums but not of ``n``,
    so give complete rows.  Columns hold at most ten digits before the point."""
    sums = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 10 ** 9)  # needs no text on the way to a decimal
        x = F.when(whole, value.cast("bigint").cast(f"decimal(16,{PLACES})")).otherwise(F.col(f"`{c}`").cast(f"decimal(16,{PLACES})"))
        sums += [F.sum(x).alias(f"s{i}"), F.sum((x * x).cast(f"decimal(32,{2 * PLACES})")).alias(f"q{i}")]
    row = df.agg(*sums).first()
    n, mean, deviation = row["n"], [], []
    for i in range(len(columns)):
        s, q = row[f"s{i}"] or Decimal(0), row[f"q{i}"] or Decimal(0)
        mean.append(float(_EXACT.divide(s, Decimal(max(n, 1)))))
        spread = _EXACT.subtract(_EXACT.multiply(Decimal(n), q), _EXACT.multiply(s, s))  # n^2 times the variance
        deviation.append(float(_EXACT.divide(_EXACT.sqrt(spread), Decimal(max(n, 1)))))
    return Moments(list(columns), n, mean, deviation)
