"""Co-located buckets, semi-join reduction, month partitions, grouping sets."""

import datetime as dt
import uuid

import pytest
from helpers import claim, patient, provider
from pyspark.sql import functions as F

from claimspark import operators as ops
from claimspark.operators.semijoin import bloom_words, reduce_by_keys
from claimspark.plans import one_scan, profiles, rules
from claimspark.plans.features import claim_features, disease_means
from claimspark.schemas import CLAIMS
from claimspark.session import shared_dir
from claimspark.sources import layout


def rows(df, order=("claim_id",)):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- co-located tables -----------------------------------------------------------------

def _world(frames):
    claims = [claim(f"C{i:04d}", pid="P0" if i % 3 == 0 else f"P{i % 40}", amount=100 + i, disease=["Cardiac", "Renal"][i % 2])
              for i in range(400)]
    claims += [claim(f"N{i}", pid=None) for i in range(5)] + [claim("X1", pid="unknown")]
    return frames(claims, [patient(f"P{i}", age=20 + i) for i in range(45)], [provider("V1")])


def test_colocated_features_equal_the_plain_join(spark, frames):
    c, p, v = _world(frames)
    stored = layout.save_colocated(spark, c, {"patients": p}, "patient_id", f"co_{uuid.uuid4().hex[:8]}", buckets=4)
    assert {r["patient_id"] for r in stored.hot_keys.collect()} == {"P0"}
    assert stored.hot.count() == 134 + 5 + (400 // 40 - len([i for i in range(0, 400, 40) if i % 3 == 0]))  # the hot key and the null key
    means = disease_means(c)
    got = stored.apply(lambda facts, dims: claim_features(facts, dims["patients"], v, means))
    assert rows(got) == rows(claim_features(c, p, v, means)) and got.count() == c.count()


def test_cold_keys_join_without_a_shuffle(spark, frames, no_broadcast):
    c, p, v = _world(frames)
    stored = layout.save_colocated(spark, c, {"patients": p}, "patient_id", f"co_{uuid.uuid4().hex[:8]}", buckets=4)
    joined = stored.apply(lambda facts, dims: facts.join(dims["patients"].select("patient_id", "age"), "patient_id", "left"))
    plan = _executed(joined)
    assert "Exchange hashpartitioning(patient_id" not in plan and "SortMergeJoin" in plan
    assert "Bucketed: true" in plan and "BroadcastHashJoin" in plan  # buckets beside buckets, hot keys by broadcast
    plain = _executed(c.join(p.select("patient_id", "age"), "patient_id", "left"))
    assert "Exchange hashpartitioning(patient_id" in plain


def test_colocated_empty_tables(spark, frames):
    c, p, v = frames()
    stored = layout.save_colocated(spark, c, {"patients": p}, "patient_id", f"co_{uuid.uuid4().hex[:8]}", buckets=2)
    assert stored.apply(lambda facts, dims: facts.join(dims["patients"], "patient_id", "left")).count() == 0


# --- semi-join reduction ------------------------------------------------------------------

def test_reduction_loses_nothing_and_lets_few_others_pass(spark):
    facts = spark.range(20_000).select((F.col("id") % 5000).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    wanted = spark.range(0, 5000, 4).select(F.col("id").alias("w"))
    exact = reduce_by_keys(facts, "k", wanted, "w")
    assert exact.count() == 5000 and exact.filter("k % 4 <> 0 OR k IS NULL").count() == 0
    bloom = reduce_by_keys(facts, "k", wanted, "w", exact_up_to=10)
    assert bloom.columns == ["k", "id"]
    assert bloom.filter("k % 4 = 0").count() == 5000
    assert bloom.filter("k IS NULL").count() == 0 and bloom.filter("k % 4 <> 0").count() < 0.05 * 15_000
    whole = reduce_by_keys(facts, "k", wanted, "w", exact_up_to=10, max_words=8)  # too few bits: left out
    assert whole.count() == 20_000
    assert bloom_words(wanted, "w", 64).count() == 64
    assert reduce_by_keys(facts, "k", wanted.filter("w < 0"), "w").count() == 0


def test_reduction_of_text_keys_with_nulls_and_repeats(spark):
    facts = spark.createDataFrame([(f"k{i % 300}",) for i in range(3000)] + [(None,)], "k string")
    wanted = spark.createDataFrame([(f"k{i % 30}",) for i in range(90)] + [(None,)], "k string")
    for limit in (1000, 3):
        out = reduce_by_keys(facts, "k", wanted, exact_up_to=limit)
        assert out.filter(F.col("k").isin([f"k{i}" for i in range(30)])).count() == 300
        assert out.count() < 600


def test_q8_shuffles_only_wanted_patients(spark, frames, monkeypatch):
    c, p, _ = frames([claim(f"C{i}", pid=f"P{i % 200}", amount=60_000) for i in range(1000)],
                     [patient(f"P{i}", kyc="No" if i % 4 == 0 else "Yes") for i in range(200)])
    for limit in (100_000, 5):
        monkeypatch.setattr(rules, "reduce_by_keys", lambda *a, n=limit: reduce_by_keys(*a, exact_up_to=n))
        got = rules.kyc_high_claims(c, p, reduce=True)
        assert rows(got) == rows(rules.kyc_high_claims(c, p)) and got.count() == 50
        reduced = reduce_by_keys(c, "patient_id", p.filter("kyc_verified = 'No'"), exact_up_to=limit)
        assert 50 <= reduced.select("patient_id").distinct().count() < 65  # of 200 patients


# --- months ---------------------------------------------------------------------------------

def test_months_are_pruned_when_the_query_runs(spark, frames):
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in (1, 15, 28)]
    c, _, _ = frames([claim(f"C{i}", date=d, amount=100 + i) for i, d in enumerate(days * 3)])
    stored = layout.write_by_month(c, shared_dir(spark, "by-month"), "claim_date")
    assert rows(stored.drop("month")) == rows(c)
    wanted = spark.createDataFrame([("2024-03",), ("2024-07",), ("2030-01",), (None,)], "month string")
    out = layout.months_of(stored, wanted)
    plan = _executed(out)
    assert "dynamicpruningexpression(month" in plan
    read = {r["f"].split("month=")[1][:7] for r in out.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {"2024-03", "2024-07"}
    want = rows(profiles.monthly_trend(c.filter(F.month("claim_date").isin(3, 7))))
    assert rows(profiles.monthly_trend(out.drop("month"))) == want


def test_a_month_with_most_rows_and_null_dates(spark):
    data = [claim(f"C{i}", date="2024-05-05") for i in range(300)] + [claim("D", date="2024-06-01")]
    c = spark.createDataFrame([*data, (*claim("Z")[:7], None, *claim("Z")[8:])], CLAIMS)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        path = shared_dir(spark, "hot-month")
        stored = layout.write_by_month(c.repartition(4), path, "claim_date")
        files = stored.select(F.input_file_name().alias("f")).distinct().filter(F.col("f").contains("month=2024-05")).count()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert files > 1  # the hot month is split
    assert stored.count() == 302 and stored.filter("month IS NULL").count() == 1
    assert layout.months_of(stored, stored.select("month")).count() == 301


# --- one scan ---------------------------------------------------------------------------------

def test_count_tables_equal_the_single_operators(spark):
    data = [claim(f"C{i}", disease=["Cardiac", None, "Renal"][i % 3], date=str(dt.date(2024, 1 + i % 5, 1 + i % 28)), days=i % 4,
                  procs=i % 7, fraud=int(i % 6 == 0)) for i in range(200)]
    data += [(*claim("Z1")[:7], None, *claim("Z1")[8:]), (*claim("Z2")[:11], None)]
    c = spark.createDataFrame(data, CLAIMS)
    got = one_scan.count_tables(c)
    want = {"eda_class_balance": ops.class_balance(c, "is_fraud"), "eda_rate_by_disease": ops.rate_by(c, "disease_category", "is_fraud"),
            "eda_monthly": ops.monthly_counts(c, "claim_date", "is_fraud"), "eda_stay_procedure_grid": profiles.stay_procedure_grid(c)}
    assert got.keys() == want.keys()
    for name, df in want.items():
        assert rows(got[name]) == rows(df), name
        assert got[name].columns == df.columns
    plan = one_scan.grouped(c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Expand" in plan
    assert all(df.count() == 0 for df in one_scan.count_tables(c.limit(0)).values())
