"""Property and skew tests: operators against brute force on random inputs,
and rule queries when one key holds a third of all rows."""

import datetime as dt
import itertools
import random

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimspark.operators.pairs import near_pairs
from claimspark.operators.ranking import global_rank
from claimspark.plans import profiles, rules
from helpers import claim, patient, provider

BASE = dt.date(2024, 1, 1)

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["p1", "p2"]), st.sampled_from(["a", "b"]), st.integers(0, 120)),
    min_size=0, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, lo=st.integers(0, 5), span=st.integers(0, 40), symmetric=st.booleans())
def test_near_pairs_equals_brute_force(spark, rows, lo, span, symmetric):
    hi = lo + span
    data = [(p, d, f"c{i:03d}", BASE + dt.timedelta(days=day)) for i, (p, d, day) in enumerate(rows)]
    df = spark.createDataFrame(data, "p string, d string, cid string, day date")
    want = set()
    for a, b in itertools.permutations(data, 2):
        if a[:2] == b[:2] and a[2] < b[2]:
            gap = (b[3] - a[3]).days
            if (lo <= abs(gap) <= hi) if symmetric else (lo <= gap <= hi):
                want.add((a[2], b[2]))
    got = [(r["cid_1"], r["cid_2"]) for r in
           near_pairs(df, ["p", "d"], "cid", "day", lo, hi, symmetric=symmetric).collect()]
    assert len(got) == len(set(got))  # every pair exactly once
    assert set(got) == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 6)), min_size=1, max_size=60),
       partitions=st.integers(1, 4), descending=st.booleans())
def test_global_rank_equals_sql_rank(spark, values, partitions, descending):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = {r["id"]: r["r"] for r in df.select("id", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
    got = {r["id"]: r["rank"] for r in global_rank(df, "v", descending=descending, partitions=partitions).collect()}
    assert got == want


def test_rules_with_one_patient_holding_a_third_of_claims(frames):
    rnd = random.Random(21)
    claims, n = [], 900
    for i in range(n):
        pid = "HOT" if i % 3 == 0 else f"P{rnd.randint(1, 40)}"
        claims.append(claim(f"C{i:04d}", pid=pid, prov="V0" if i % 3 == 0 else f"V{rnd.randint(1, 9)}",
                            disease=rnd.choice(["Cardiac", "Eye", "Dental"]),
                            amount=rnd.choice([500, 1000, 5000, 60000, 150000]),
                            days=rnd.randint(1, 5), procs=rnd.randint(1, 12),
                            date=str(BASE + dt.timedelta(days=rnd.randint(0, 200))),
                            fraud=int(rnd.random() < 0.2)))
    pats = [patient("HOT", kyc="No")] + [patient(f"P{i}", kyc=rnd.choice(["Yes", "No"])) for i in range(1, 41)]
    provs = [provider("V0", empanelled="No")] + [provider(f"V{i}") for i in range(1, 10)]
    c, p, v = frames(claims=claims, patients=pats, providers=provs)
    pdf = pd.DataFrame(claims, columns=c.columns)
    pdf["amt"] = pdf["claim_amount"].astype(float)
    kyc = {r[0]: r[-1] for r in pats}

    # Query 8 against pandas
    g = pdf.groupby("patient_id").agg(n=("claim_id", "count"), tot=("amt", "sum"), f=("is_fraud", "sum"))
    want8 = {(pid, int(r.n), round(r.tot, 2), int(r.f)) for pid, r in g.iterrows()
             if kyc[pid] == "No" and r.tot > 100000}
    got8 = {(r["patient_id"], r["total_claims"], r["total_claimed"], r["fraud_count"])
            for r in rules.kyc_high_claims(c, p).collect()}
    assert got8 == want8

    # Query 1 against pandas
    means = pdf.groupby("disease_category")["amt"].mean()
    want1 = set(pdf.loc[pdf["amt"] > 2 * pdf["disease_category"].map(means), "claim_id"])
    assert {r["claim_id"] for r in rules.claim_inflation(c, p).collect()} == want1

    # provider risk against pandas
    rk = pdf.groupby("provider_id").agg(t=("claim_id", "count"), f=("is_fraud", "sum"))
    got = {r["provider_id"]: (r["total_claims"], r["fraud_claims"]) for r in
           profiles.risk_profile(c, "provider_id").collect()}
    assert got == {k: (int(r.t), int(r.f)) for k, r in rk.iterrows() if r.t >= 5}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.one_of(st.integers(-50, 50).map(float),
                             st.floats(-1e3, 1e3, allow_nan=False, allow_infinity=False)),
                   min_size=1, max_size=50),
       bins=st.integers(1, 12))
def test_histogram_equals_numpy(spark, xs, bins):
    import numpy as np
    from claimspark.operators.histogram import histogram
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = histogram(df, "x", bins).collect()
    counts, edges = np.histogram(np.array(xs), bins=bins)
    assert [r["n_rows"] for r in got] == counts.tolist()
    assert np.allclose([r["bin_lo"] for r in got], edges[:-1])
    assert got[-1]["bin_hi"] == edges[-1]
