"""Range partitions with halo exchange against every pair."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.operators.sweep import sweep_pairs

SCHEMA = "p string, d int, cid bigint, day date, amount int"
START = dt.date(1969, 11, 1)  # days before and after 0


def brute(rows, lo, hi, symmetric):
    out = []
    for a in rows:
        for b in rows:
            if None in (a[0], a[1], a[2], a[3], b[0], b[1], b[2], b[3]) or a[:2] != b[:2] or not a[2] < b[2]:
                continue
            gap = (b[3] - a[3]).days
            if lo <= (abs(gap) if symmetric else gap) <= hi:
                out.append((a[0], a[1], a[2], b[2], a[4], b[4], a[3], b[3], gap))
    return sorted(out)


def swept(spark, rows, lo, hi, symmetric, parts):
    df = sweep_pairs(spark.createDataFrame(rows, SCHEMA), ["p", "d"], "cid", "day", lo, hi, carry=["amount", "p"],
                     symmetric=symmetric, parts=parts)
    assert df.columns == ["p", "d", "cid_1", "cid_2", "amount_1", "amount_2", "date_1", "date_2", "days_apart"]
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(1, 2), st.integers(0, 120)), max_size=60),
       st.integers(-3, 3), st.integers(0, 40), st.booleans(), st.integers(1, 9))
def test_sweep_equals_brute_force(spark, drawn, lo, span, symmetric, parts):
    rows = [(p, d, i * 7919 % 100_003, START + dt.timedelta(days=t), i) for i, (p, d, t) in enumerate(drawn)]
    assert swept(spark, rows, lo, lo + span, symmetric, parts) == brute(rows, lo, lo + span, symmetric)


@pytest.mark.parametrize("parts", [1, 16])
def test_a_hot_key_over_many_parts(spark, parts):
    """Most rows of one key, many a day: parts narrower than the band meet several others."""
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 4 else f"p{i}", 1, i, START + dt.timedelta(days=int(rng.integers(0, 60))), 0) for i in range(400)]
    rows += [("hot", 1, 1000 + i, START, 0) for i in range(20)]  # one day
    assert swept(spark, rows, 1, 30, False, parts) == brute(rows, 1, 30, False)


def test_equal_ids_have_no_order_and_an_empty_table_no_pairs(spark):
    rows = [("x", 1, 5, START, 0), ("x", 1, 5, START + dt.timedelta(days=3), 0), ("x", 1, 6, START, 0)]
    assert swept(spark, rows, 0, 9, True, 3) == brute(rows, 0, 9, True)
    assert swept(spark, [], 1, 30, False, 3) == []
    with pytest.raises(ValueError):
        sweep_pairs(spark.createDataFrame(rows, SCHEMA), ["p"], "cid", "day", 3, 1)


def test_only_halos_are_copied(spark):
    """Of rows that all lie far apart nothing is copied; near an edge the band is."""
    df = spark.createDataFrame([("x", 1, i, START + dt.timedelta(days=i * 40), 0) for i in range(200)], SCHEMA)
    out = sweep_pairs(df, ["p", "d"], "cid", "day", 1, 30, parts=8)
    assert out.count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    out.write.format("noop").mode("overwrite").save()
    cells = [m for m in out._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in m]
    assert cells  # one pass over the cells
