"""Key and reference checks, as reports (Spark does not enforce PK/FK)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once or contain a null, with their count.

    One grouped count (partial aggregation first, so a heavily repeated key
    costs one row per map task in the shuffle).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    any_null = None
    for k in keys:
        c = F.col(k).isNull()
        any_null = c if any_null is None else any_null | c
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter((F.col("n_rows") > 1) | any_null))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent row (a left anti join).

    Parent keys are de-duplicated first (partial aggregation), so a parent key
    repeated many times cannot skew the build side; a hot child key is split
    by AQE's skew handling, which supports left anti joins.
    """
    parent_keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return (child.filter(F.col(child_key).isNotNull())
            .join(parent_keys, F.col(child_key) == F.col("_pk"), "left_anti"))


def orphan_count(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row ``n_orphans``: child rows whose non-null key has no parent.

    Child and parent keys meet in one grouped count: a key is a row of a map task
    on either side, even if it holds a third of all rows, and nothing is sorted
    or joined.
    """
    both = (child.select(F.col(child_key).alias("_k"), F.lit(1).cast("bigint").alias("_n"))
            .unionAll(parent.select(F.col(parent_key).alias("_k"), F.lit(None).cast("bigint").alias("_n"))))
    per_key = both.filter(F.col("_k").isNotNull()).groupBy("_k").agg(
        F.count("_n").alias("_n"), F.count_if(F.col("_n").isNull()).alias("_parents"))
    missing = per_key.filter("_parents = 0")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_orphans"))


def orphan_report(tables: dict[str, DataFrame],
                  relations: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Number of orphan rows per foreign key ``(child, key, parent, key)``."""
    parts = []
    for child, ck, parent, pk in relations:
        o = orphan_count(tables[child].select(ck), ck, tables[parent].select(pk), pk)
        parts.append(o.select(F.lit(f"{child}.{ck}").alias("foreign_key"),
                              F.lit(f"{parent}.{pk}").alias("references"), "n_orphans"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_report(tables: dict[str, DataFrame], primary_keys: dict[str, Sequence[str]]) -> DataFrame:
    """Per table: rows, distinct keys, duplicated key values and null keys."""
    parts = []
    for name, keys in primary_keys.items():
        v = key_violations(tables[name].select(*keys), keys)
        parts.append(v.agg(F.count(F.lit(1)).alias("n_violating_keys"),
                           F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_violating_rows"))
                     .select(F.lit(name).alias("table_name"), "n_violating_keys", "n_violating_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
