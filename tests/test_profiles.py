from decimal import Decimal

import pytest

from claimspark.operators.aggregates import class_balance, rate_by
from claimspark.plans import profiles
from claimspark.plans.features import claim_features
from helpers import claim, patient, provider

# FIXED VALUES: rows of the published risk table that the library must reproduce:
# provider, total_claims, fraud_claims, total_billed, avg_claim, fraud_rate, risk_tier
GOLDEN = [
    ("PROV0001", 99, 6, "14015269.84", 141568.38222222222, 6.0606060606060606, "LOW"),
    ("PROV0017", 129, 20, "21511089.03", 166752.6281395349, 15.503875968992247, "MEDIUM"),
    ("PROV0046", 100, 8, "14334887.33", 143348.8733, 8.0, "LOW"),
    ("PROV0049", 99, 20, "19152911.26", 193463.75010101008, 20.2020202020202, "HIGH"),
    ("PROV0080", 111, 21, "20591693.79", 185510.75486486487, 18.91891891891892, "HIGH"),
    ("PROV0085", 103, 19, "19232285.88", 186721.22213592232, 18.446601941747574, "HIGH"),
    ("PROV0089", 115, 20, "17816954.36", 154930.03791304346, 17.391304347826086, "MEDIUM"),
]


def _golden_claims():
    rows = []
    for prov, total, fraud, billed, *_ in GOLDEN:
        billed = Decimal(billed)
        each = (billed / total).quantize(Decimal("0.01"))
        amounts = [each] * (total - 1) + [billed - each * (total - 1)]
        for i, amt in enumerate(amounts):
            rows.append(claim(f"{prov}-{i:04d}", pid=f"P{i % 7}", prov=prov, amount=amt,
                              fraud=1 if i < fraud else 0,
                              date=f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}"))
    # A provider with few claims but many frauds: ranked, then filtered out.
    rows += [claim(f"PROVX-{i}", prov="PROVX", fraud=1) for i in range(9)]
    return rows


@pytest.fixture()
def golden(frames):
    provs = [provider(g[0]) for g in GOLDEN] + [provider("PROVX")]
    pats = [patient(f"P{i}") for i in range(7)]
    return frames(claims=_golden_claims(), patients=pats, providers=provs)


def test_provider_risk_reproduces_golden_rows(golden):
    c, p, v = golden
    risk = profiles.risk_profile(claim_features(c, p, v), "provider_id")
    got = {r["provider_id"]: r for r in risk.collect()}
    for prov, total, fraud, billed, avg, rate, tier in GOLDEN:
        r = got[prov]
        assert (r["total_claims"], r["fraud_claims"], r["risk_tier"]) == (total, fraud, tier)
        assert r["fraud_rate"] == pytest.approx(rate, rel=1e-12)
        assert r["avg_claim"] == pytest.approx(avg, rel=1e-9)
        assert r["total_billed"] == pytest.approx(float(billed), rel=1e-12)
    assert got["PROV0046"]["fraud_rate"] == 8.0 and got["PROV0046"]["risk_tier"] == "LOW"
    top = [r["provider_id"] for r in profiles.top_high_risk(risk).collect()]
    assert top == ["PROVX", "PROV0049", "PROV0080", "PROV0085"]


def test_provider_rank_ties_and_hole(golden):
    c, _, v = golden
    rows = profiles.provider_rank(c, v).collect()
    got = [(r["provider_id"], r["fraud_rank"]) for r in rows]
    # PROVX (9 frauds, rank 6) is ranked over all providers, then dropped by
    # total_claims >= 10, leaving a hole at 6.
    assert got == [("PROV0080", 1), ("PROV0017", 2), ("PROV0049", 2), ("PROV0089", 2),
                   ("PROV0085", 5), ("PROV0046", 7), ("PROV0001", 8)]
    first3 = profiles.provider_rank(c, v, limit=3).collect()
    assert [r["provider_id"] for r in first3] == ["PROV0080", "PROV0017", "PROV0049"]
    r80 = rows[0]
    assert (str(r80["fraud_rate_pct"]), str(r80["total_billed"])) == ("18.92", "20591693.79")


def test_monthly_trend_and_disease_profile(frames):
    c, _, _ = frames(claims=[
        claim("C1", date="2024-01-05", fraud=1, amount=300), claim("C2", date="2024-01-20", amount=100),
        claim("C3", date="2024-02-01", amount=50, disease="Eye"),
    ])
    months = {r["month"]: r for r in profiles.monthly_trend(c).collect()}
    assert months["2024-01"]["fraud_rate_pct"] == 50.0 and months["2024-01"]["fraud_amount"] == 300.0
    assert months["2024-02"]["fraud_claims"] == 0 and months["2024-02"]["fraud_amount"] == 0.0
    prof = {r["disease_category"]: r for r in profiles.disease_profile(c).collect()}
    assert prof["Eye"]["avg_fraud_amount"] is None and prof["Eye"]["fraud_count"] == 0
    assert prof["Cardiac"]["avg_claim_amount"] == 200.0 and prof["Cardiac"]["max_claim_amount"] == 300.0


def test_class_balance_and_rates(frames):
    c, p, v = frames(
        claims=[claim("C1", fraud=1), claim("C2"), claim("C3"), claim("C4", pid="MISSING")],
        patients=[patient("P1", policy="Family")], providers=[provider("V1")])
    bal = {r["is_fraud"]: r for r in class_balance(c, "is_fraud").collect()}
    assert bal[0]["n_rows"] == 3 and bal[1]["share_pct"] == 25.0
    assert sum(r["n_rows"] for r in bal.values()) == 4
    # the claim without a patient has a null policy type, dropped from the rate table
    pol = rate_by(claim_features(c, p, v), "policy_type", "is_fraud").collect()
    assert [(r["policy_type"], r["n"], r["fraud_rate"]) for r in pol] == [("Family", 3, 100 / 3)]
