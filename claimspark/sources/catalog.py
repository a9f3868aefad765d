"""Register the claims tables for SQL use.

Temporary views need no metastore and cost nothing (they are named plans).
With ``database`` the tables are written as managed Parquet tables instead,
bucketed on the given keys so later joins and aggregations on those keys read
co-located data without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.session import shared_dir


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """``CREATE OR REPLACE TEMP VIEW`` for each table; returns the names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def save_tables(spark: SparkSession, tables: dict[str, DataFrame], database: str,
                location: str | None = None,
                buckets: dict[str, tuple[int, list[str]]] | None = None) -> list[str]:
    """``CREATE DATABASE IF NOT EXISTS`` + ``USE`` + one Parquet table per frame.

    The database stays the session's current one, as after ``USE``.

    The database and its tables live under ``location`` (default: a folder in
    the shared checkpoint directory), never in a machine-local warehouse.
    ``buckets`` maps a table to ``(n, columns)`` for ``bucketBy``.
    """
    location = location or shared_dir(spark, f"db-{database}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    spark.catalog.setCurrentDatabase(database)
    for name, df in tables.items():
        w = df.write.mode("overwrite").format("parquet").option("path", f"{location}/{name}")
        if buckets and name in buckets:
            n, cols = buckets[name]
            w = w.bucketBy(n, *cols).sortBy(*cols)
        w.saveAsTable(f"`{database}`.`{name}`")
    return list(tables)
