"""Near-duplicate pairs: rows sharing a key whose dates are a few days apart.

The self-join is an equi-join on the grouping keys plus a band condition on
dates.  A plain sort-merge join compares every row of a key group with every
other row, which is quadratic for a hot key (one patient holding a large share
of all claims).  With ``bucketed=True`` (the default) each row also carries a
date bucket of ``hi - lo + 1`` days: a row is copied to its own bucket and to every
bucket its partner dates can fall in (two in all for a directional band, three for
a symmetric one), and both sides of the join read these copies from one shuffle.
The join key then includes the bucket, so the work per key is bounded by the rows in
neighbouring windows, and each qualifying pair counts in exactly one bucket, that of
its first row, so no pair repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV


def near_pairs(df: DataFrame, keys: Sequence[str], id_col: str, date_col: str,
               lo: int = FV.DUPLICATE_MIN_DAYS, hi: int = FV.DUPLICATE_MAX_DAYS,
               carry: Sequence[str] = (), symmetric: bool = False,
               bucketed: bool = True) -> DataFrame:
    """Pairs (a, b) with equal ``keys``, ``a.id < b.id`` and a day gap in ``[lo, hi]``.

    Directional (default): the gap is ``datediff(b.date, a.date)``, so only pairs
    whose smaller id has the earlier date qualify.  ``symmetric=True`` uses the
    absolute gap instead.  Output columns: ``keys``, ``{id}_1``, ``{id}_2``,
    ``{c}_1``/``{c}_2`` for each carried column, ``date_1``, ``date_2`` and
    ``days_apart = datediff(date_2, date_1)``.
    """
    if hi < lo:
        raise ValueError("hi must be >= lo")
    keys = list(keys)
    cols = keys + [id_col, date_col] + [c for c in carry if c not in keys]
    base = df.select(*cols)
    a_date, b_date = F.col(f"a.{date_col}"), F.col(f"b.{date_col}")
    conds = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    if bucketed:
        width = (hi - lo + 1) if not symmetric else max(hi, 1)

        def bucket(day):
            return F.floor(day / F.lit(width))

        # Partner days of a row as the later one: [day - hi, day - lo] (directional) or
        # [day - hi, day + hi] (symmetric).  Copy the row to its own bucket and to each in range.
        day = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date"))
        range_of = F.sequence(bucket(day - F.lit(hi)), bucket(day + F.lit(hi) if symmetric else day - F.lit(lo)))
        base = base.withColumn("_bucket", F.explode(F.array_union(F.array(bucket(day)), range_of)))
        # As expressions: from equal columns Spark would infer which copies are own ones and
        # filter these below the shuffle, so the sides would no longer share it.
        conds.append(-F.col("a._bucket") == -F.col("b._bucket"))
        into = F.datediff(a_date, F.lit("1970-01-01").cast("date")) - F.col("b._bucket") * F.lit(width)
        conds.append((into >= 0) & (into < width))  # a's own bucket
    gap = F.datediff(b_date, a_date)
    band = F.abs(gap).between(lo, hi) if symmetric else gap.between(lo, hi)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    cond = cond & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & band
    joined = base.alias("a").join(base.alias("b"), cond, "inner")
    out = [F.col(f"a.{k}").alias(k) for k in keys]
    out += [F.col(f"a.{id_col}").alias(f"{id_col}_1"), F.col(f"b.{id_col}").alias(f"{id_col}_2")]
    for c in carry:
        if c in keys:
            continue
        out += [F.col(f"a.{c}").alias(f"{c}_1"), F.col(f"b.{c}").alias(f"{c}_2")]
    out += [F.col(f"a.{date_col}").alias("date_1"), F.col(f"b.{date_col}").alias("date_2"),
            F.datediff(F.col(f"b.{date_col}"), F.col(f"a.{date_col}")).alias("days_apart")]
    return joined.select(*out)
