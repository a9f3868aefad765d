"""Key and reference checks kept up batch by batch.

The reports of ``operators.quality`` regroup the whole table.  Here the counts per
key are stored once in the shared folder as segments, one for each batch; a new
batch is summed per key, the segments are first reduced to the keys it may hold
(``reduce_by_keys``), and only those meet it in a shuffle.  The totals of the full
report follow from the changes.  Segments are merged when there are many.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.operators.semijoin import reduce_by_keys
from claimspark.session import stored

#: Segments beyond this number are merged into one.
MAX_SEGMENTS = 8


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class KeyIndex:
    """Rows of every key seen so far; ``report`` is that of ``key_report`` for the table."""

    def __init__(self, keys: str | Sequence[str]):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.segments: list[DataFrame] = []
        self.violating_keys = self.violating_rows = 0

    def _any_null(self) -> Column:
        return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch in.  Returns the keys of it that violate uniqueness now, with
        ``n_before`` rows in earlier batches and ``n_batch`` in this one."""
        new = stored(batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_batch")), "key-batch")
        none = F.lit(0).cast("bigint")
        met = new.select(*self.keys, none.alias("n_before"), "n_batch")
        if self.segments:
            hashed = F.xxhash64(*self.keys)
            seen = reduce_by_keys(_union(self.segments).withColumn("_k", hashed), "_k", new.withColumn("_k", hashed), "_k", True)
            met = (met.unionByName(seen.select(*self.keys, F.col("n").alias("n_before"), none.alias("n_batch")))
                   .groupBy(*self.keys).agg(F.sum("n_before").alias("n_before"), F.sum("n_batch").alias("n_batch"))
                   .filter("n_batch > 0"))
        null, total = self._any_null(), F.col("n_before") + F.col("n_batch")
        met = met.withColumns({"was": (F.col("n_before") > 0) & ((F.col("n_before") > 1) | null), "is": (total > 1) | null})
        change = met.agg(F.sum(F.col("is").cast("int") - F.col("was").cast("int")).alias("keys"),
                         F.sum(F.when(F.col("is"), total).otherwise(0) - F.when(F.col("was"), F.col("n_before")).otherwise(0)).alias("rows")).first()
        self.violating_keys += change["keys"] or 0
        self.violating_rows += change["rows"] or 0
        self.segments.append(new.withColumnRenamed("n_batch", "n"))
        if len(self.segments) > MAX_SEGMENTS:
            self.segments = [stored(_union(self.segments).groupBy(*self.keys).agg(F.sum("n").alias("n")), "key-segment")]
        return met.filter("is").select(*self.keys, "n_before", "n_batch")

    def report(self, like: DataFrame, name: str) -> DataFrame:
        """table_name, n_violating_keys, n_violating_rows."""
        return like.sparkSession.createDataFrame([(name, self.violating_keys, self.violating_rows)],
                                                 "table_name string, n_violating_keys bigint, n_violating_rows bigint")


class ReferenceIndex:
    """Child rows without a parent among all batches so far, in whatever order
    parents and children arrive."""

    def __init__(self, child_key: str, parent_key: str):
        self.child_key, self.parent_key = child_key, parent_key
        self.parents: list[DataFrame] = []  # (key)
        self.pending: list[DataFrame] = []  # (key, n): children that wait for a parent

    def add_parents(self, batch: DataFrame) -> None:
        new = stored(batch.select(F.col(self.parent_key).alias("key")).filter("key IS NOT NULL").distinct(), "parent-keys")
        self.parents.append(new)
        if len(self.parents) > MAX_SEGMENTS:
            self.parents = [stored(_union(self.parents).distinct(), "parent-segment")]
        if self.pending:
            self.pending = [stored(_union(self.pending).join(new, "key", "left_anti"), "children-waiting")]

    def add_children(self, batch: DataFrame) -> DataFrame:
        """Take child rows in; returns (key, n) of those without a parent so far."""
        new = stored(batch.select(F.col(self.child_key).alias("key")).filter("key IS NOT NULL")
                     .groupBy("key").agg(F.count(F.lit(1)).alias("n")), "child-batch")
        if self.parents:
            known = stored(reduce_by_keys(_union(self.parents), "key", new, "key", True), "parents-met")
            missing = stored(new.join(known, "key", "left_anti"), "children-missing")
        else:
            missing = new
        self.pending.append(missing)
        if len(self.pending) > MAX_SEGMENTS:
            self.pending = [stored(_union(self.pending).groupBy("key").agg(F.sum("n").alias("n")), "children-waiting")]
        return missing

    def orphans(self) -> int:
        """Child rows without a parent."""
        return _union(self.pending).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if self.pending else 0
