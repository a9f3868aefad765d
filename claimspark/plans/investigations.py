"""Open investigations for a share of the fraud claims.

A repeatable, distributed version of "sample 75% of the fraud claims and
open a numbered case for each": the sample, the case attributes and the
recovered share are all functions of the claim id and a seed, and the case
numbers come from range partitions of the hash order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark import fixed_values as FV
from claimspark.functions import round_double, stable_unit_hash, unit_interval
from claimspark.operators.ranking import sequential_ids
from claimspark.operators.sampling import exact_sample, hash_sample
from claimspark.schemas import MONEY
from claimspark.session import stored


def _pick(values: list[str], claim_id: str, seed: int):
    arr = F.array(*[F.lit(v) for v in values])
    idx = (stable_unit_hash(claim_id, seed) % F.lit(len(values))).cast("int") + F.lit(1)
    return F.element_at(arr, idx)


def open_investigations(claims: DataFrame, fraction: float = FV.INVESTIGATED_FRACTION,
                        seed: int = FV.SPLIT_SEED, low: float = FV.RECOVERY_LOW,
                        high: float = FV.RECOVERY_HIGH, id_format: str = FV.INVESTIGATION_ID_FORMAT,
                        exact: bool = False) -> DataFrame:
    """Investigation rows for about ``fraction`` of the fraud claims; ``exact``: for
    exactly that share of them.

    ``investigation_id`` numbers the sampled claims 1, 2, ... in (hash, claim_id)
    order; ``fraud_type`` and ``status`` are drawn from the fixed lists;
    ``amount_recovered = round(claim_amount x U(low, high), 2)``.
    """
    fraud = claims.filter(F.col("is_fraud") == 1).select(
        "claim_id", "patient_id", "claim_amount", "claim_date")
    picked = (exact_sample if exact else hash_sample)(fraud, "claim_id", fraction, seed)
    h = stable_unit_hash("claim_id", seed)
    # The numbering samples its input for the bounds; the drawn claims are a
    # small share, so they are written once instead of scanning all twice.
    numbered = sequential_ids(stored(picked.withColumn("_h", h), "picked-claims"), ["_h", "claim_id"], out="_seq")
    share = F.lit(low) + F.lit(high - low) * unit_interval("claim_id", seed + 2)
    return numbered.select(
        F.format_string(id_format, F.col("_seq")).alias("investigation_id"),
        "claim_id", "patient_id",
        _pick(FV.FRAUD_TYPES, "claim_id", seed + 1).alias("fraud_type"),
        F.col("claim_date").alias("investigation_date"),
        _pick(FV.INVESTIGATION_STATUSES, "claim_id", seed + 3).alias("status"),
        round_double(F.col("claim_amount").cast("double") * share).cast(MONEY).alias("amount_recovered"),
    )
