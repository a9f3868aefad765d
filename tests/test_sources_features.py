import os
import time

from pyspark.sql import functions as F

from claimspark.plans.features import claim_features, disease_means
from claimspark.plans.investigations import open_investigations
from claimspark.schemas import CLAIMS, PROVIDERS
from claimspark.sources import readers, sinks
from claimspark.sources.catalog import register_views
from claimspark.streaming import flag_claims, start_flagging
from helpers import claim, patient, provider


def test_provider_csv_with_quoted_commas_round_trip(spark, frames, tmp_dir):
    _, _, v = frames(providers=[provider("V1", name='Gupta, Shah and "Sons" Hospital', empanelled="No"),
                                provider("V2")])
    sinks.write_table(v, f"{tmp_dir}/prov", "csv")
    back = readers.read_providers(spark, f"{tmp_dir}/prov")
    assert sorted(back.collect()) == sorted(v.collect())


def test_ingest_csv_separates_rejected_rows(spark, tmp_dir):
    path = f"{tmp_dir}/claims.csv"
    os.makedirs(path)
    header = ",".join(CLAIMS.fieldNames())
    good = "C1,P1,V1,Cardiac,123.45,2,3,2024-01-02,0,1,Approved,0"
    bad = "C2,P1,V1,Cardiac,not-a-number,2,3,2024-01-02,0,1,Approved,0"
    with open(f"{path}/part-0.csv", "w") as fh:
        fh.write("\n".join([header, good, bad]) + "\n")
    ok, rejected = readers.ingest_csv(spark, path, CLAIMS, f"{tmp_dir}/claims_parquet")
    assert [r["claim_id"] for r in ok.collect()] == ["C1"]
    assert str(ok.first()["claim_amount"]) == "123.45"
    rej = rejected.collect()
    assert len(rej) == 1 and "not-a-number" in rej[0]["_corrupt_record"]


def test_sinks_write_named_extracts(spark, frames, tmp_dir):
    c, p, v = frames(claims=[claim("C1"), claim("C2", fraud=1)], patients=[patient("P1")],
                     providers=[provider("V1")])
    feats = claim_features(c, p, v)
    sinks.write_claims_analysis(feats, f"{tmp_dir}/ca")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/ca")
    assert back.columns[:3] == ["claim_id", "patient_id", "provider_id"] and back.count() == 2
    assert register_views(spark, {"claims_t": c}) == ["claims_t"]
    assert spark.sql("SELECT COUNT(*) AS n FROM claims_t").first()["n"] == 2
    assert PROVIDERS.fieldNames()[0] == "provider_id"


def test_features_null_dimension_and_zero_procedures(frames):
    c, p, v = frames(
        claims=[claim("C1", pid="P1", procs=0, amount=500, days=1), claim("C2", pid="NOPE", procs=9, days=2),
                claim("C3", prov="V2", amount=100)],
        patients=[patient("P1", kyc=None)], providers=[provider("V1", empanelled="No")])
    rows = {r["claim_id"]: r for r in claim_features(c, p, v).collect()}
    assert rows["C1"]["cost_per_procedure"] == 500.0  # divisor 0 replaced by 1
    assert rows["C1"]["kyc_risk"] == 0 and rows["C2"]["kyc_risk"] == 0 and rows["C2"]["age"] is None
    assert rows["C1"]["not_empanelled"] == 1 and rows["C3"]["not_empanelled"] == 0
    assert rows["C2"]["suspicious_pattern"] == 1 and rows["C1"]["suspicious_pattern"] == 0
    assert rows["C1"]["claim_month"] == 1 and rows["C1"]["claim_year"] == 2024
    avg = (500 + 1000 + 100) / 3
    assert rows["C1"]["inflation_ratio"] == 500 / avg and rows["C1"]["is_inflated"] == 0


def test_open_investigations_ids_and_amounts(frames):
    c, _, _ = frames(claims=[claim(f"C{i:03d}", fraud=1, amount=1000) for i in range(200)]
                     + [claim("L1", fraud=0)])
    inv = open_investigations(c).collect()
    assert 120 < len(inv) < 180
    assert sorted(r["investigation_id"] for r in inv) == [f"INV{i:05d}" for i in range(1, len(inv) + 1)]
    assert all(400 <= float(r["amount_recovered"]) <= 900 for r in inv)
    assert "L1" not in {r["claim_id"] for r in inv}


def test_stream_flagging_matches_batch(spark, frames, tmp_dir):
    c, p, v = frames(claims=[claim("C1", procs=9, days=1, amount=5000), claim("C2"), claim("C3")],
                     patients=[patient("P1")], providers=[provider("V1")])
    src = f"{tmp_dir}/incoming"
    c.write.parquet(src)
    stream = spark.readStream.schema(CLAIMS).parquet(src)
    means = disease_means(c)
    q = start_flagging(spark, stream, p, v, means, f"{tmp_dir}/flagged",
                       checkpoint=f"{tmp_dir}/ckpt", available_now=True)
    q.awaitTermination(120)
    for _ in range(50):
        if not q.isActive:
            break
        time.sleep(0.2)
    got = spark.read.parquet(f"{tmp_dir}/flagged").select("claim_id", "suspicious_pattern", "is_inflated")
    want = flag_claims(c, p, v, means).select("claim_id", "suspicious_pattern", "is_inflated")
    assert sorted(got.collect()) == sorted(want.collect())


def test_save_tables_in_a_database_under_a_given_location(spark, frames, tmp_dir):
    from claimspark.sources.catalog import save_tables
    c, _, _ = frames(claims=[claim("C1"), claim("C2", pid="P2")])
    current = spark.catalog.currentDatabase()
    try:
        save_tables(spark, {"claims": c}, "claims_db_test", location=f"{tmp_dir}/db",
                    buckets={"claims": (4, ["patient_id"])})
        assert spark.table("claims_db_test.claims").count() == 2
        assert os.path.isdir(f"{tmp_dir}/db/claims")
    finally:
        spark.catalog.setCurrentDatabase(current)


# Invented lines with commas and quotes inside quoted names.
PROVIDER_LINES = """provider_id,hospital_name,city,provider_type,empanelled
V-1,Plain Clinic,Northtown,Public,Yes
V-2,"Oak, Elm and Ash Clinic",Southtown,Laboratory,Yes
V-3,"The ""Blue"" House, West",Easttown,Public,No
"""


def test_reads_quoted_names(spark, tmp_dir):
    path = f"{tmp_dir}/providers.csv"
    with open(path, "w") as fh:
        fh.write(PROVIDER_LINES)
    rows = {r["provider_id"]: r for r in readers.read_providers(spark, path).collect()}
    assert len(rows) == 3
    assert rows["V-2"]["hospital_name"] == "Oak, Elm and Ash Clinic"
    assert rows["V-3"]["hospital_name"] == 'The "Blue" House, West'
    assert rows["V-3"]["empanelled"] == "No" and rows["V-2"]["provider_type"] == "Laboratory"


def test_cli_runs_the_whole_analysis_from_csv(spark, tmp_dir):
    from claimspark.__main__ import main
    from claimspark.sources.mapping import load_tables
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    for name, df in load_tables(spark, sf).items():
        sinks.write_table(df, f"{tmp_dir}/in/{name}.csv", "csv")
    main([f"{tmp_dir}/in", f"{tmp_dir}/out", "--no-models"])
    assert spark.read.parquet(f"{tmp_dir}/out/q1_claim_inflation").count() == 345
    assert spark.read.parquet(f"{tmp_dir}/out/q2_duplicate_pairs").count() == 276
    risk = spark.read.option("header", True).csv(f"{tmp_dir}/out/provider_risk")
    assert risk.columns == ["provider_id", "total_claims", "fraud_claims", "total_billed", "avg_claim",
                            "fraud_rate", "risk_tier"]
    extract = spark.read.option("header", True).csv(f"{tmp_dir}/out/claim_extract")
    assert len(extract.columns) == 11 and extract.count() == load_tables(spark, sf)["claims"].count()


def test_a_csv_round_trip_is_compressed(spark, tmp_dir):
    import glob

    import __spark_entry__ as entry
    found = entry.src_claims(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".csv.gz") for f in found.inputFiles())
    want = entry._t(spark, "/root/testdata/sf0.001")["claims"]
    assert found.schema.names == want.columns and found.exceptAll(want.select([F.col(c).cast(found.schema[c].dataType) for c in want.columns])).count() == 0
    assert found.count() == want.count()
    path = sinks.write_table(want.limit(5), f"{tmp_dir}/plain", "csv")
    assert glob.glob(f"{path}/*.csv")  # only where it is asked for
