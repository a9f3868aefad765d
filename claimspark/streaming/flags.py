"""Flag claims as they arrive.

The per-claim features are row-wise plus left joins to three static tables
(patients, providers, category means), which Structured Streaming supports
as stream-static joins; no state is kept, so any number of claims can pass.
The category means are a static snapshot (e.g. last night's batch job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimspark.plans.features import claim_features
from claimspark.session import shared_dir


def flag_claims(claims_stream: DataFrame, patients: DataFrame, providers: DataFrame,
                means: DataFrame) -> DataFrame:
    """The claim feature frame for a streaming (or batch) claims DataFrame."""
    return claim_features(claims_stream, patients, providers, means=means)


def start_flagging(spark: SparkSession, claims_stream: DataFrame, patients: DataFrame,
                   providers: DataFrame, means: DataFrame, sink_path: str,
                   checkpoint: str | None = None, available_now: bool = False,
                   fmt: str = "parquet") -> StreamingQuery:
    """Append flagged claims to ``sink_path`` (exactly once via the checkpoint).

    The checkpoint defaults to a folder under the shared checkpoint directory,
    so a restarted driver resumes where the previous one stopped.
    """
    flagged = flag_claims(claims_stream, patients, providers, means)
    ckpt = checkpoint or shared_dir(spark, "flagging-stream")
    w = flagged.writeStream.format(fmt).option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_path)
