"""Equal-width histograms, optionally per class, as tables.

Same bins as ``numpy.histogram(x, bins)``: ``bins`` equal-width bins between
the minimum and maximum of the data (per class when ``by`` is given), the
last bin closed on the right, a zero-width range widened to +-0.5.  A value's
bin is computed arithmetically and then compared with that bin's two edges
and moved by one if it lies outside, so values on an edge fall where numpy
puts them.  The counts are one grouped aggregate (partial before the shuffle);
no raw values move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import BROADCAST_ROWS, stored


def value_ranges(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, total) of the non-null values of every non-null class."""
    x = F.col(col).cast("double")
    data = df.filter(x.isNotNull())
    for k in keys:
        data = data.filter(F.col(k).isNotNull())
    return data.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("total"))


def histogram(df: DataFrame, col: str, bins: int, by: str | Sequence[str] | None = None,
              density: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """One row per (class, bin): ``bin`` (0-based), ``bin_lo``, ``bin_hi``,
    ``n_rows`` and, with ``density``, ``density = n / (N_class * width)``.

    Every bin is present, empty ones with 0; no values at all give no rows.
    Null values and rows with a null class are ignored.  ``ranges`` (as from
    ``value_ranges``) saves the pass that finds them.
    """
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    ranges = (value_ranges(df, col, keys) if ranges is None else ranges).filter("total > 0")
    whole = not keys  # one range for all: a constant key
    if whole:
        keys, df, ranges = ["_all"], df.withColumn("_all", F.lit(0)), ranges.withColumn("_all", F.lit(0))
    ranges = stored(ranges, "ranges")
    same = F.col("lo") == F.col("hi")
    ranges = ranges.select(*keys, F.col("total").alias("_total"),
                           F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("_lo"),
                           F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("_hi")).withColumn(
        "_width", (F.col("_hi") - F.col("_lo")) / F.lit(bins))
    x = F.col(col).cast("double")
    data = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull())
    side = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    data = data.join(side, keys, "inner")

    def edge(i):
        return F.when(i == bins, F.col("_hi")).otherwise(i.cast("double") * F.col("_width") + F.col("_lo"))

    first = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(bins)).cast("int")
    data = data.withColumn("_b", F.least(F.greatest(first, F.lit(0)), F.lit(bins - 1)))
    data = data.withColumn("_b", F.when(F.col("_x") < edge(F.col("_b")), F.col("_b") - 1).otherwise(F.col("_b")))
    data = data.withColumn("_b", F.when((F.col("_x") >= edge(F.col("_b") + 1)) & (F.col("_b") != bins - 1),
                                        F.col("_b") + 1).otherwise(F.col("_b")))
    counts = data.groupBy(*keys, F.col("_b").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = (grid.join(counts, [*keys, "bin"], "left")
           .select(*keys, "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
                   F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"), "_total", "_width"))
    if density:
        out = out.withColumn("density", F.col("n_rows") / (F.col("_total") * F.col("_width")))
    return out.orderBy(*keys, "bin").drop("_total", "_width", "_all")
