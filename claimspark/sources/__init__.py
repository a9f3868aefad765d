"""Sources and sinks: typed CSV/Parquet readers, CSV ingestion, writers,
view registration, and the mapping of the driver's tables onto the claims model."""

from claimspark.sources.catalog import register_views, save_tables  # noqa: F401
from claimspark.sources.mapping import load_tables  # noqa: F401
from claimspark.sources.readers import (  # noqa: F401
    ingest_csv, read_claims, read_investigations, read_patients, read_providers, read_table,
)
from claimspark.sources.sinks import write_claims_analysis, write_provider_risk, write_table  # noqa: F401
