import datetime as dt
import itertools
import random

from claimspark.operators.pairs import near_pairs
from claimspark.plans import rules
from helpers import claim, patient, provider


def test_inflation_uses_category_mean_and_inner_join(frames):
    c, p, _ = frames(
        claims=[claim("C1", amount=100), claim("C2", amount=100), claim("C3", amount=100),
                claim("C4", amount=1000), claim("C5", pid="MISSING", amount=1000),
                claim("C6", disease="Eye", amount=10)],
        patients=[patient("P1")])
    rows = rules.claim_inflation(c, p).collect()
    # mean of Cardiac = 2300 / 5 = 460; 1000 > 920 for C4 and C5, C5 has no patient
    assert [r["claim_id"] for r in rows] == ["C4"]
    assert rows[0]["category_avg"] == 460 and float(rows[0]["inflation_ratio"]) == 2.17


def _pairs(frames, claims, symmetric=False, bucketed=True):
    c, p, _ = frames(claims=claims, patients=[patient("P1"), patient("P2")])
    out = rules.duplicate_pairs(c, p, symmetric=symmetric, bucketed=bucketed)
    return sorted((r["claim_1"], r["claim_2"], r["days_apart"]) for r in out.collect())


def test_pairs_day_band_and_direction(frames):
    claims = [claim("A", date="2024-01-01"), claim("B", date="2024-01-01"),   # 0 days: no
              claim("C", date="2024-01-02"),                                   # 1 day after A/B
              claim("D", date="2024-01-31"),                                   # 30 days after A
              claim("E", date="2024-02-01"),                                   # 31 after A
              claim("F", date="2023-12-31", pid="P2"), claim("G", date="2023-12-20", pid="P2"),
              claim("H", date="2024-01-05", disease="Eye")]
    got = _pairs(frames, claims)
    assert ("A", "C", 1) in got and ("B", "C", 1) in got
    assert ("A", "D", 30) in got and ("A", "E", 31) not in got
    assert ("A", "B", 0) not in got
    # smaller id with the later date: F (12-31) < G (12-20) by id, so directional misses it
    assert not any(a == "F" for a, _, _ in got)
    sym = _pairs(frames, claims, symmetric=True)
    assert ("F", "G", -11) in sym
    assert set(got) <= set(sym)
    assert not any(x == "H" or y == "H" for x, y, _ in got)


def _brute(rows, lo, hi, symmetric):
    out = set()
    for a, b in itertools.permutations(rows, 2):
        if a[0] == b[0] and a[1] == b[1] and a[2] < b[2]:
            gap = (b[3] - a[3]).days
            if (lo <= abs(gap) <= hi) if symmetric else (lo <= gap <= hi):
                out.add((a[2], b[2], gap))
    return out


def test_pairs_bucketed_match_brute_force_on_a_hot_key(spark):
    # One patient holds most claims: the bucketed join must give exactly the
    # pairs of the unbucketed join and of a brute-force enumeration.
    rnd = random.Random(7)
    base = dt.date(2023, 1, 1)
    rows = [("HOT" if rnd.random() < 0.6 else f"P{rnd.randint(1, 20)}", rnd.choice(["x", "y"]),
             f"C{i:05d}", base + dt.timedelta(days=rnd.randint(0, 400))) for i in range(700)]
    df = spark.createDataFrame(rows, "pid string, d string, cid string, day date")
    for symmetric in (False, True):
        want = _brute(rows, 1, 30, symmetric)
        for bucketed in (True, False):
            got = {(r["cid_1"], r["cid_2"], r["days_apart"]) for r in
                   near_pairs(df, ["pid", "d"], "cid", "day", 1, 30, symmetric=symmetric,
                              bucketed=bucketed).collect()}
            assert got == want, (symmetric, bucketed)


def test_non_empanelled_high_value(frames):
    c, p, v = frames(
        claims=[claim("C1", prov="V1", amount=60000), claim("C2", prov="V2", amount=60000),
                claim("C3", prov="V1", amount=50000)],
        patients=[patient("P1")],
        providers=[provider("V1", empanelled="No", name='Shah, Rao "Care" Hospital'),
                   provider("V2")])
    rows = rules.non_empanelled_high_value(c, p, v).collect()
    assert [r["claim_id"] for r in rows] == ["C1"]
    assert rows[0]["hospital_name"] == 'Shah, Rao "Care" Hospital'


def test_procedure_burst(frames):
    c, p, _ = frames(
        claims=[claim("C1", procs=8, days=2, amount=800), claim("C2", procs=7, days=1),
                claim("C3", procs=9, days=3), claim("C4", procs=10, days=0, amount=1000)],
        patients=[patient("P1")])
    rows = rules.procedure_burst(c, p).collect()
    assert [(r["claim_id"], r["cost_per_procedure"]) for r in rows] == [("C1", 100.0), ("C4", 100.0)]


def test_kyc_high_claims_having_and_null_kyc(frames):
    c, p, _ = frames(
        claims=[claim("C1", pid="P1", amount=60000, fraud=1), claim("C2", pid="P1", amount=50000),
                claim("C3", pid="P2", amount=200000), claim("C4", pid="P3", amount=90000)],
        patients=[patient("P1", kyc="No"), patient("P2", kyc=None), patient("P3", kyc="No")])
    rows = rules.kyc_high_claims(c, p).collect()
    assert [(r["patient_id"], r["total_claims"], r["total_claimed"], r["fraud_count"]) for r in rows] \
        == [("P1", 2, 110000.0, 1)]
