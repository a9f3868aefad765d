"""Global ordering without a single-partition sort.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
The operators here range-partition the rows instead (Spark samples the bounds,
so the partitions are balanced whatever the values are) and note each row's
partition number in a stored copy.  A window per partition gives the running
sums inside it, and the per-partition totals, one row a partition, give each
partition its offset.  Values are compared by Spark's own ordering, so big
integers, decimals, strings, dates, NaN and nulls rank as in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import stored

PARTITION = "_part"


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def range_partitioned(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """A stored copy of ``df`` with ``PARTITION``: partitions follow ``order``.

    ``partitions`` defaults to ``spark.sql.shuffle.partitions``; adaptive
    execution merges small neighbours.
    """
    cols = _columns(order)
    dealt = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return stored(dealt.withColumn(PARTITION, F.spark_partition_id()), "ranged")


def exclusive_prefix(df: DataFrame, order: Sequence[str | Column], values: Sequence[str],
                     inclusive: bool = False, suffix: str | None = None,
                     partition_by: Sequence[str] = (), partitions: int | None = None,
                     ranged: bool = False) -> DataFrame:
    """Running sums of ``values`` along ``order`` over the whole frame, or within
    each group of ``partition_by``.

    For every row adds ``{v}{suffix}``: the sum of ``v`` over all rows (of its
    group) strictly before it (``inclusive=True`` also counts the row itself).
    ``order`` must be a total order (unique per row).  A group never sits in
    one task: its rows are spread over the range partitions, and only the table
    of per-(group, partition) totals is ordered.  ``ranged``: ``df`` comes from
    ``range_partitioned`` by the same groups and order.
    """
    groups = list(partition_by)
    suffix = suffix if suffix is not None else ("_upto" if inclusive else "_before")
    if not ranged:
        df = range_partitioned(df, [*groups, *order], partitions)
    within = (Window.partitionBy(*groups, PARTITION).orderBy(*_columns(order))
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    earlier = Window.partitionBy(*groups).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = df.groupBy(*groups, PARTITION).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values]).select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col(PARTITION).alias("_p"),
        *[F.coalesce(F.sum(f"_tot_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}")
          for v in values])
    inside = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{v}") for v in values])
    same = [F.col(PARTITION) == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]]
    res = inside.join(offsets, same, "inner")
    return res.select(*[c for c in df.columns if c != PARTITION],
                      *[(F.col(f"_off_{v}") + F.col(f"_in_{v}")).alias(f"{v}{suffix}") for v in values])


def value_counts_ranked(df: DataFrame, col: str, descending: bool = True, partitions: int | None = None) -> DataFrame:
    """One row per distinct value of ``col`` with ``n`` and its ``RANK()``.

    Ties share a rank and leave gaps; nulls come last when descending and first
    when ascending, NaN counts as the largest number (Spark's SQL ordering).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_first()
    pre = exclusive_prefix(counts, [order], ["_n"], partitions=partitions)
    return pre.select(col, F.col("_n").alias("n"), (F.col("_n_before") + 1).alias("rank"))


def global_rank(df: DataFrame, col: str, out: str = "rank", descending: bool = True,
                partitions: int | None = None, population: DataFrame | None = None) -> DataFrame:
    """``RANK() OVER (ORDER BY col [DESC])`` for every row, without a one-task sort.

    With ``population`` the rank is that among its rows (``df`` may then be a
    part of it, such as a top-k).  The table of ranks has one row per distinct
    value; the join back is a null-safe equi-join that adaptive execution
    broadcasts or splits by measured size, so a value holding a third of the
    rows does not land in one task.
    """
    ranks = value_counts_ranked(df if population is None else population, col, descending, partitions).select(
        F.col(col).alias("_rv"), F.col("rank").alias(out))
    return df.join(ranks, df[col].eqNullSafe(ranks["_rv"]), "inner").drop("_rv")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows in ``order`` (give a unique tie-break as the last key).

    Planned as ``TakeOrderedAndProject``: each task keeps its own top ``k`` and
    only ``k x tasks`` rows reach the final merge.
    """
    return df.orderBy(*order).limit(k)


def sequential_ids(df: DataFrame, order: Sequence[str | Column], out: str = "seq", start: int = 1,
                   partition_by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Number the rows ``start, start+1, ...`` along a total ``order`` (``row_number``
    over the whole frame, or per ``partition_by`` group) without one task per
    frame or group."""
    staged = df.withColumn("_one", F.lit(1).cast("bigint"))
    res = exclusive_prefix(staged, order, ["_one"], partition_by=partition_by, partitions=partitions)
    return res.withColumn(out, F.col("_one_before") + F.lit(start)).drop("_one", "_one_before")
