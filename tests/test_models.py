import os

import pytest
from pyspark.sql import functions as F

from claimspark.plans import models
from claimspark.plans.features import claim_features
from claimspark.sources.mapping import load_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="testdata not present")
def test_models_fit_score_and_compare(spark):
    t = load_tables(spark, SF)
    feats = claim_features(t["claims"], t["patients"], t["providers"])
    enc = models.encode(feats).select("disease_category", "disease_enc").distinct().collect()
    labels = sorted(r["disease_category"] for r in enc)
    assert {r["disease_category"]: r["disease_enc"] for r in enc} == {lab: i for i, lab in enumerate(labels)}
    prepared = models.prepare(feats)
    m = models.FraudModels(prepared, trees=3, rounds=3, max_iter=20, max_train_rows=1_000, max_depth=8)
    assert 850 < m.sample.count() < 1150
    n_test = m.test.count()
    assert 0.15 * prepared.count() < n_test < 0.25 * prepared.count()
    scored = m.scored("logistic")
    assert scored.columns == ["claim_id", "label", "probability", "prediction"]
    assert scored.count() == n_test
    assert scored.filter((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    aucs = {r["model"]: r["auc"] for r in m.comparison().collect()}
    assert set(aucs) == {"logistic", "forest", "boosted"} and min(aucs.values()) > 0.9
    imp = models.importances(m.boosted()).collect()
    assert len(imp) == 12 and imp[0]["importance"] >= imp[-1]["importance"]
    assert {r["feature"] for r in imp} <= set(models.FEATURES)
