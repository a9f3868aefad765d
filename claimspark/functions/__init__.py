"""Column-level helpers: every function here returns a ``Column`` built from
built-in Spark expressions, so it stays inside whole-stage code generation."""

from claimspark.functions.columns import (  # noqa: F401
    as_double,
    band,
    eq_flag,
    flag,
    mean_of,
    pct,
    round_double,
    round_half_up,
    round_pct,
    round_ratio,
    safe_divisor,
    stable_unit_hash,
    tier,
    unit_interval,
)
