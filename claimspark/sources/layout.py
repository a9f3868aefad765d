"""Stored layouts of the claims tables that later queries profit from.

``save_colocated`` writes a fact table and its dimensions in buckets of one key,
so they join without a shuffle.  Keys with more than ``hot_rows`` fact rows (and
null keys) would each fill one bucket; they go to a table of their own that is
not bucketed, and their few dimension rows are broadcast.

``write_by_month`` partitions rows by calendar month; ``months_of`` reads the months
that another table names, pruned when the query runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.session import shared_dir, stored

MONTH = "month"


@dataclass(frozen=True)
class Colocated:
    """A fact table in buckets of ``key`` (``cold``), its rows of hot and null keys
    (``hot``), and dimensions in the same buckets."""

    key: str
    cold: DataFrame
    hot: DataFrame
    hot_keys: DataFrame  # a bounded number of rows
    dimensions: dict[str, DataFrame]

    def apply(self, run: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """``run(facts, dimensions)`` of both parts: bucket beside bucket for the cold
        keys, a broadcast of the hot keys' dimension rows for the others.  ``run``
        must treat every fact row by itself."""
        few = {name: F.broadcast(d.join(F.broadcast(self.hot_keys), self.key, "left_semi")) for name, d in self.dimensions.items()}
        return run(self.cold, self.dimensions).unionByName(run(self.hot, few))


def save_colocated(spark: SparkSession, facts: DataFrame, dimensions: dict[str, DataFrame], key: str, database: str,
                   buckets: int, hot_rows: int | None = None, location: str | None = None) -> Colocated:
    """Write the tables ``facts``, ``facts_hot`` and the dimensions into ``database`` (in the
    shared folder).  A key is hot beyond ``hot_rows`` rows (default: an average bucket),
    so at most ``rows / hot_rows`` keys are.  One file a bucket."""
    location = location or shared_dir(spark, f"db-{database}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    counts = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = hot_rows or max(1, facts.count() // buckets)
    hot_keys = stored(counts.filter(F.col("_n") > limit).select(key), "hot-keys")
    marked = facts.join(F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), key, "left")
    is_hot = F.col("_hot").isNotNull() | F.col(key).isNull()

    def save(df: DataFrame, name: str, bucketed: bool) -> DataFrame:
        w = (df.repartition(buckets, key) if bucketed else df).write.mode("overwrite").format("parquet")
        w = w.option("path", f"{location}/{name}")
        if bucketed:  # the partitions are those of the buckets: one file each
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"`{database}`.`{name}`")
        return spark.table(f"`{database}`.`{name}`")

    cold = save(marked.filter(~is_hot).select(*facts.columns), "facts", True)
    hot = save(marked.filter(is_hot).select(*facts.columns), "facts_hot", False)
    return Colocated(key, cold, hot, hot_keys, {name: save(d, name, True) for name, d in dimensions.items()})


def write_by_month(df: DataFrame, path: str, date_col: str) -> DataFrame:
    """Write ``df`` partitioned by ``month`` (yyyy-MM of ``date_col``; null dates apart) and
    read it back.  Partitions are rebalanced by size: a month that holds most rows
    becomes several files, small months are not split."""
    out = df.withColumn(MONTH, F.date_format(date_col, FV.MONTH_FORMAT))
    out.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(path)
    kinds = out.schema
    return df.sparkSession.read.schema(kinds).parquet(path)


def months_of(by_month: DataFrame, months: DataFrame) -> DataFrame:
    """The rows of ``by_month`` in the months that ``months`` (column month) names; which
    files are read is decided by that table when the query runs."""
    # the comparison (true for every month) tells the planner that pruning is worth it;
    # a calendar has few months: bounded whatever the rows
    wanted = months.select(MONTH).distinct().filter(F.col(MONTH) > F.lit(""))
    return by_month.join(F.broadcast(wanted), MONTH, "left_semi").select(*by_month.columns)
