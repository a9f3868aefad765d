"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark import fixed_values as FV


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: str | Column) -> Column:
    return _c(c).cast("double")


def round_half_up(c: str | Column, digits: int = 2) -> Column:
    """Round an exact number (decimal or integer) half away from zero to
    ``digits`` places, as SQL's ``ROUND`` does; decimals stay decimals."""
    return F.round(_c(c), digits)


def round_ratio(numerator: str | Column, denominator: str | Column, digits: int = 2, places: int = 2) -> Column:
    """``numerator / denominator`` rounded half away from zero to ``digits``
    places, as DECIMAL(20, digits); null where the denominator is 0 or null.

    Integer arithmetic on exact inputs: the numerator has at most ``places``
    decimal places, the denominator is an integer (a decimal denominator is
    scaled by the caller).  No intermediate quotient is rounded.
    """
    num = (_c(numerator) * F.lit(10 ** places)).cast("decimal(38,0)")
    den = _c(denominator).cast("decimal(38,0)") * F.lit(10 ** places).cast("decimal(38,0)")
    doubled = (F.abs(num) * F.lit(2 * 10 ** digits).cast("decimal(38,0)") + F.abs(den)).cast("decimal(38,0)")
    units = F.call_function("div", doubled, F.abs(den) * F.lit(2)).cast("decimal(20,0)")
    signed = F.when((num < 0) != (den < 0), -units).otherwise(units)
    return F.when(den != 0, (signed / F.lit(10 ** digits)).cast(f"decimal(20,{digits})"))


def round_pct(numerator: str | Column, denominator: str | Column, digits: int = 2) -> Column:
    """``numerator * 100 / denominator`` of two counts, rounded exactly."""
    return round_ratio(_c(numerator) * F.lit(100), denominator, digits, places=0)


def round_double(c: str | Column, digits: int = 2) -> Column:
    """A double rounded half up by ``floor(x * 10^d + 0.5) / 10^d``: the same
    IEEE value in every engine.  For inexact inputs only."""
    scale = 10 ** digits
    return F.floor(as_double(c) * scale + F.lit(0.5)).cast("double") / F.lit(float(scale))


def pct(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator * 100 / denominator`` as double; null when the denominator is 0."""
    den = as_double(denominator)
    return F.when(den != 0, as_double(numerator) * F.lit(100.0) / den)


def mean_of(total: str | Column, count: str | Column) -> Column:
    """Exact sum (decimal or integer) divided by a count, as double; null on 0."""
    den = as_double(count)
    return F.when(den != 0, as_double(total) / den)


def flag(condition: Column) -> Column:
    """Boolean condition as 0/1 integer, with null counted as 0 (pandas ``astype(int)``)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def eq_flag(c: str | Column, value) -> Column:
    return flag(_c(c) == F.lit(value))


def safe_divisor(c: str | Column) -> Column:
    """Replace a zero divisor by 1 (the per-unit cost guard)."""
    return F.when(_c(c) == 0, F.lit(1)).otherwise(_c(c))


def tier(c: str | Column, edges: Sequence[float] = tuple(FV.RISK_TIER_EDGES),
         labels: Sequence[str] = tuple(FV.RISK_TIER_LABELS), right_closed: bool = True) -> Column:
    """Bin a value into labelled intervals; values outside every interval give null.

    With ``right_closed`` the intervals are ``(e0, e1], (e1, e2], ...`` (so a rate of
    exactly 8.0 is LOW); otherwise ``[e0, e1), ...``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    x = as_double(c)
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        inside = (x > lo) & (x <= hi) if right_closed else (x >= lo) & (x < hi)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def band(c: str | Column, danger_above: float = FV.BAND_DANGER_ABOVE,
         warning_above: float = FV.BAND_WARNING_ABOVE) -> Column:
    """Severity band of a rate: ``danger`` / ``warning`` / ``ok``."""
    x = as_double(c)
    return (F.when(x > danger_above, F.lit("danger"))
            .when(x > warning_above, F.lit("warning"))
            .otherwise(F.lit("ok")))


def stable_unit_hash(c: str | Column, seed: int | str = FV.SPLIT_SEED) -> Column:
    """A repeatable 32-bit hash in ``[0, 2^32)`` of a value and a seed.

    Built from ``md5`` so any SQL engine can recompute it
    (``conv(substr(md5(v || ':' || seed), 1, 8), 16, 10)``); it needs no
    shuffle and does not change when the data is re-partitioned or an
    executor is lost and the task is re-run.
    """
    text = F.concat(_c(c).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_interval(c: str | Column, seed: int | str = FV.SPLIT_SEED) -> Column:
    """``stable_unit_hash`` scaled to ``[0, 1)``."""
    return stable_unit_hash(c, seed).cast("double") / F.lit(4294967296.0)
