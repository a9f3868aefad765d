"""Row counts and values expected on the mapped driver tables (FIXTURES.md)."""

import os

import pytest

import __spark_entry__ as E

EXPECTED = {
    "/root/testdata/sf0.1": {
        "q1_claim_inflation": 34524, "q2_duplicate_pairs": 25908,
        "q2_duplicate_pairs_symmetric": 52193, "q3_non_empanelled_high_value": 84057,
        "q4_procedure_burst": 82822, "q5_provider_rank": 20, "q6_monthly_trend": 83,
        "q7_disease_profile": 6, "q8_kyc_high_claims": 3748, "eda_amount_hist": 80,
    },
    "/root/testdata/sf0.01": {
        "q1_claim_inflation": 3482, "q2_duplicate_pairs": 2679,
        "q2_duplicate_pairs_symmetric": 5228, "q3_non_empanelled_high_value": 8513,
        "q4_procedure_burst": 8255, "q5_provider_rank": 20, "q8_kyc_high_claims": 375,
    },
}
AUC = {"/root/testdata/sf0.1": 0.83747, "/root/testdata/sf0.01": 0.83945}
TIERS = {"/root/testdata/sf0.1": {"LOW": 6034, "MEDIUM": 8149, "HIGH": 808},
         "/root/testdata/sf0.01": {"LOW": 600, "MEDIUM": 810, "HIGH": 88}}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_counts(spark, sf):
    if not os.path.exists(sf):
        pytest.skip("testdata not present")
    qs = E.queries()
    for key, n in EXPECTED[sf].items():
        assert qs[key](spark, sf).count() == n, key
    assert round(qs["eval_auc"](spark, sf).first()["auc"], 5) == AUC[sf]
    tiers = {r["risk_tier"]: r["n_rows"] for r in qs["patient_risk_tiers"](spark, sf).collect()}
    assert tiers == TIERS[sf]
    cm = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in qs["eval_confusion"](spark, sf).collect()}
    if sf.endswith("0.01"):
        assert cm == {0: (54258, 0), 1: (2260, 3482)}
