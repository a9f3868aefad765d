"""Repeatable sampling and train/test splits from a per-row hash.

The decision for a row depends only on its id and a seed, so it needs no
shuffle, is identical on every run and survives task re-execution (unlike
``rand()``-based sampling over a re-ordered input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import stable_unit_hash, unit_interval
from claimspark.session import lookup_join, stored

_HASH_SPACE = 4294967296  # 2^32


def hash_sample(df: DataFrame, id_col: str, fraction: float, seed: int = FV.SPLIT_SEED) -> DataFrame:
    """Rows whose id hashes below ``fraction`` (about ``fraction`` of the rows)."""
    return df.filter(unit_interval(id_col, seed) < F.lit(float(fraction)))


def hash_split(df: DataFrame, id_col: str, test_fraction: float = FV.TEST_FRACTION,
               seed: int = FV.SPLIT_SEED, out: str = "is_test") -> DataFrame:
    """Mark about ``test_fraction`` of the rows as test rows (``out`` = 1).

    Each class keeps about the same share, since the hash is independent of
    the label.  See ``exact_stratified_split`` for exact per-class counts.
    """
    return df.withColumn(out, (unit_interval(id_col, seed) < F.lit(float(test_fraction))).cast("int"))


def exact_stratified_split(df: DataFrame, id_col: str, label: str,
                           test_fraction: float = FV.TEST_FRACTION, seed: int = FV.SPLIT_SEED,
                           out: str = "is_test", buckets: int = 1 << 16, half_even: bool = False) -> DataFrame:
    """Exactly ``round(test_fraction * n_class)`` test rows per class (the
    class sizes of a stratified split), chosen by the smallest (hash, id).
    A half is rounded up, or to the even number with ``half_even``.

    Only the k-th (hash, id) of each class is looked for: counts per (class,
    hash range) tell which of ``buckets`` hash ranges holds it, and just the
    rows of that range are numbered.  Two aggregating passes over the id and
    label, then the rows are compared with their class's cut-off; no row is
    sorted or copied, and a class holding almost every row is no special case.
    Rows without a label are left out.
    """
    marked = (df.filter(F.col(label).isNotNull()).withColumn("_h", stable_unit_hash(id_col, seed))
              .withColumn("_hb", F.floor(F.col("_h") * F.lit(buckets) / F.lit(_HASH_SPACE))))
    counts = stored(marked.groupBy(label, "_hb").agg(F.count(F.lit(1)).alias("_n")), "hash-counts")
    rounded = F.bround if half_even else F.round
    sizes = counts.groupBy(label).agg(
        rounded(F.sum("_n") * F.lit(float(test_fraction))).cast("bigint").alias("_k"))
    upto = Window.partitionBy(label).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
                .join(sizes, label).filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k")))
                .select(label, "_hb", (F.col("_k") - F.col("_before")).alias("_nth")))
    order = Window.partitionBy(label).orderBy("_h", id_col)
    cut = (lookup_join(marked.select(label, id_col, "_h", "_hb"), crossing, [label, "_hb"])
           .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == F.col("_nth"))
           .select(label, F.struct("_h", F.col(id_col).alias("_id")).alias("_cut")))
    here = F.struct("_h", F.col(id_col).alias("_id"))
    return (lookup_join(marked, cut, [label], "left")
            .withColumn(out, F.coalesce(here <= F.col("_cut"), F.lit(False)).cast("int"))
            .select(*df.columns, out))


def exact_sample(df: DataFrame, id_col: str, fraction: float, seed: int = FV.SPLIT_SEED) -> DataFrame:
    """Exactly ``fraction`` of the rows (a half goes to the even number, as in a pandas
    sample): those whose id hashes lowest, found without sorting the rows."""
    marked = exact_stratified_split(df.withColumn("_all", F.lit(1)), id_col, "_all", fraction, seed, out="_in", half_even=True)
    return marked.filter(F.col("_in") == 1).select(*df.columns)
