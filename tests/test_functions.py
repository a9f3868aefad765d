from decimal import Decimal as Dec

from pyspark.sql import functions as F

from claimspark.functions import band, eq_flag, flag, pct, round_double, round_half_up, round_pct, round_ratio, \
    safe_divisor, tier


def _one(spark, expr, value, schema="x double"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_tier_is_right_closed(spark):
    # 8.0 is LOW and 18.0 is MEDIUM (right-closed bins), outside any bin is null.
    cases = {-1.0: None, -0.5: "LOW", 8.0: "LOW", 8.0001: "MEDIUM", 18.0: "MEDIUM",
             18.5: "HIGH", 101.0: "HIGH", 101.5: None}
    for x, want in cases.items():
        assert _one(spark, tier("x"), x) == want, x


def test_tier_left_closed_option(spark):
    assert _one(spark, tier("x", right_closed=False), 8.0) == "MEDIUM"


def test_band(spark):
    assert _one(spark, band("x"), 12.0) == "warning"
    assert _one(spark, band("x"), 12.5) == "danger"
    assert _one(spark, band("x"), 8.0) == "ok"


def test_flag_counts_null_as_zero(spark):
    df = spark.createDataFrame([("No",), ("Yes",), (None,)], "k string")
    got = [r["f"] for r in df.select(eq_flag("k", "No").alias("f")).collect()]
    assert got == [1, 0, 0]
    assert _one(spark, flag(F.col("x") > 1), None) == 0


def test_rounding_of_decimals_is_exact_and_away_from_zero(spark):
    for text, want in (("0.125", "0.13"), ("-0.125", "-0.13"), ("0.1249999", "0.12"), ("1.005", "1.01")):
        assert _one(spark, round_half_up("x"), Dec(text), "x decimal(12,7)") == Dec(want)
    total = Dec("12345678901234567.89")
    assert _one(spark, round_half_up("x"), total, "x decimal(38,2)") == total


def test_ratios_are_rounded_from_the_exact_quotient(spark):
    df = spark.createDataFrame([(Dec("100.20"), 8), (Dec("-100.20"), 8), (Dec("100.04"), 8), (Dec("1.00"), 0), (None, 3),
                                (Dec("0.01"), 3), (Dec("99999999.99"), 7), (Dec("2.00"), 3)], "x decimal(12,2), n int")
    got = [r.r for r in df.select(round_ratio("x", "n").alias("r")).collect()]
    # 100.20 / 8 = 12.525 and 100.04 / 8 = 12.505 are half a cent exactly
    want = ["12.53", "-12.53", "12.51", None, None, "0.00", "14285714.28", "0.67"]
    want[-2] = "14285714.28" if 9999999999 * 2 < 7 * (2 * 1428571428 + 1) else "14285714.29"
    assert got == [None if w is None else Dec(w) for w in want]
    counts = spark.createDataFrame([(1, 8), (1, 3), (0, 5), (3, 0)], "a bigint, b bigint")
    assert [r.p for r in counts.select(round_pct("a", "b").alias("p")).collect()] == [Dec("12.50"), Dec("33.33"), 0, None]


def test_round_double(spark):
    assert _one(spark, round_double("x"), 2.5) == 2.5 and _one(spark, round_double("x", 0), 2.5) == 3.0


def test_pct_and_zero_divisor(spark):
    df = spark.createDataFrame([(1, 4), (3, 0)], "a int, b int")
    got = [r["p"] for r in df.select(pct("a", "b").alias("p")).collect()]
    assert got == [25.0, None]
    got = [r["d"] for r in spark.createDataFrame([(0,), (5,)], "n int")
           .select(safe_divisor("n").alias("d")).collect()]
    assert got == [1, 5]
