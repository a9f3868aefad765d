"""Driver contract: entry(), every queries() key against its DuckDB oracle on
sf0.001, and plan properties (no Python UDFs, pruned scans, broadcast of the
small aggregated side, no single-task global sort)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, _rows

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="testdata not present")


@pytest.fixture(scope="module", autouse=True)
def small_models():
    """The facts hold for models of any size."""
    before, E.MODEL_ARGS = E.MODEL_ARGS, {"n_trees": 4, "rounds": 4}
    yield
    E.MODEL_ARGS = before
    E._MODELS.clear()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_data
def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["claim_id", "patient_id", "name", "disease_category", "claim_amount",
                          "category_avg", "inflation_ratio"]
    assert df.count() == 345  # inflated claims at sf0.001


def test_every_query_of_the_library_has_an_oracle():
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    # what a fit returns has no SQL; its facts have, and test_full_models recomputes the fits
    fitted = {*E.FITTED, "ml_coefficients", "ml_splits"}
    assert {k for k in qs if k not in oracle and k not in E.LLM_QUERIES} == fitted
    assert all(f"{k}_facts" in oracle for k in E.FITTED)


@needs_data
@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) - set(E.LLM_QUERIES)))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF)
    s_rows = [r.asDict() for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in cur.description]
    d_rows = [dict(zip(d_cols, r)) for r in cur.fetchall()]
    assert sorted(sdf.columns) == sorted(d_cols)
    cols = sorted(d_cols)
    assert _rows(s_rows, cols, False) == _rows(d_rows, cols, False)


@needs_data
def test_fitted_keys_return_values(spark):
    qs, n_test = E.queries(), E.queries()["ml_scale"](spark, SF).count()
    for key in ("ml_logistic", "ml_forest", "ml_boosted"):
        df = qs[key](spark, SF)
        assert df.columns == ["claim_id", "label", "probability", "prediction"] and df.count() == n_test
        assert df.select("probability").distinct().count() > 5
    aucs = {r["model"]: r["auc"] for r in qs["ml_compare"](spark, SF).collect()}
    assert set(aucs) == {"logistic", "forest", "boosted"} and min(aucs.values()) > 0.9
    top = qs["ml_importance_top"](spark, SF).collect()
    assert len(top) == 12 and 0.3 < sum(r["importance"] for r in top) <= 1 + 1e-9
    cells = qs["eval_model_confusion"](spark, SF).collect()
    assert sum(r["predicted_0"] + r["predicted_1"] for r in cells) == n_test
    assert qs["ml_coefficients"](spark, SF).count() == 21 and qs["ml_splits"](spark, SF).count() >= 4
    report = {r["class_name"]: r for r in qs["eval_model_report"](spark, SF).collect()}
    assert report["Fraud"]["precision"] > 0.8 and report["Fraud"]["recall"] > 0.5
    assert qs["eval_model_roc"](spark, SF).count() > 10


@needs_data
def test_auc_of_inflation_ratio(spark):
    assert round(E.queries()["eval_auc"](spark, SF).first()["auc"], 5) == 0.84317


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_plans_stay_in_the_jvm_and_prune(spark):
    for key in ["q1_claim_inflation", "q2_duplicate_pairs", "q5_provider_rank", "eval_auc",
                "open_investigations", "eda_amount_hist", "claim_features"]:
        plan = _plan(E.queries()[key](spark, SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key
    q1 = _plan(E.queries()["q1_claim_inflation"](spark, SF))
    # the counted table of category totals is broadcast: claims are not shuffled on the category
    assert "hashpartitioning(disease_category" not in q1 and "BroadcastHashJoin [disease_category" in q1
    q7 = E.queries()["q7_disease_profile"](spark, SF)
    scan = q7._jdf.queryExecution().executedPlan().toString()
    assert "patient_id" not in scan.split("ReadSchema")[-1].split("\n")[0]


@needs_data
def test_rank_query_sorts_no_whole_table_in_one_task(spark):
    df = E.queries()["q5_provider_rank"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Window [rank" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
