"""Writers for result tables (CSV for BI tools, Parquet for everything else).

Writes are distributed: every task writes its own file.  ``single_file``
funnels the data through one task and is meant only for small reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimspark.schemas import CLAIMS_ANALYSIS_COLUMNS


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None, single_file: bool = False, compression: str | None = None) -> str:
    """Write ``df`` to ``path`` (a folder); CSV gets a header and RFC-4180 quoting.
    ``compression`` (such as gzip) is that of Spark's writer; readers tell it by the file names."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        w.options(header="true", quote='"', escape='"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_provider_risk(risk: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> str:
    """The provider risk table (provider_id, totals, mean, rate, tier)."""
    cols = ["provider_id", "total_claims", "fraud_claims", "total_billed", "avg_claim",
            "fraud_rate", "risk_tier"]
    return write_table(risk.select(*cols), path, fmt, single_file=single_file)


def write_claims_analysis(features: DataFrame, path: str, fmt: str = "csv",
                          single_file: bool = False) -> str:
    """The 11-column claim extract."""
    return write_table(features.select(*CLAIMS_ANALYSIS_COLUMNS), path, fmt, single_file=single_file)
