import datetime as dt
import itertools
import random
import sys

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimspark.operators.evaluation import auc, classification_report, confusion_matrix, roc_points
from claimspark.operators.histogram import histogram
from claimspark.operators.pairs import near_pairs
from claimspark.operators.quality import key_violations, orphan_report, orphans
from claimspark.operators.ranking import (
    exclusive_prefix, global_rank, range_partitioned, sequential_ids, value_counts_ranked,
)
from claimspark.operators.sampling import exact_stratified_split, hash_sample, hash_split


# --- histograms ---------------------------------------------------------------

def test_histogram_matches_numpy_per_class(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.uniform(0, 100) * (1 + 2 * k)) for k in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, x double")
    out = histogram(df, "x", 40, by="k", density=True).collect()
    assert len(out) == 80
    for k in (0, 1):
        xs = np.array([x for kk, x in rows if kk == k])
        counts, edges = np.histogram(xs, bins=40)
        dens, _ = np.histogram(xs, bins=40, density=True)
        mine = sorted((r for r in out if r["k"] == k), key=lambda r: r["bin"])
        assert [r["n_rows"] for r in mine] == counts.tolist()  # max lands in the last bin
        assert np.allclose([r["density"] for r in mine], dens)
        assert np.allclose([r["bin_lo"] for r in mine], edges[:-1])
        width = edges[1] - edges[0]
        assert sum(r["density"] for r in mine) * width == pytest.approx(1.0)


def test_histogram_constant_column_and_counts(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    out = histogram(df, "x", 4).collect()
    assert [r["n_rows"] for r in out] == [0, 0, 2, 0]  # range widened to [4.5, 5.5]
    assert out[0]["bin_lo"] == 4.5 and out[-1]["bin_hi"] == 5.5


# --- ranking and prefix sums ---------------------------------------------------

def test_global_rank_matches_sql_rank_with_ties_and_nulls(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 1, 2, 2, 3, 5, 5, 5, 8])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v int")
    want = {r["id"]: r["r"] for r in df.select(
        "id", F.rank().over(Window.orderBy(F.col("v").desc())).alias("r")).collect()}
    for partitions in (None, 1, 3):
        got = {r["id"]: r["rank"] for r in global_rank(df, "v", partitions=partitions).collect()}
        assert got == want


def test_value_counts_ranked_ascending(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "v int")
    got = sorted((r["v"], r["n"], r["rank"]) for r in value_counts_ranked(df, "v", descending=False,
                                                                          partitions=2).collect())
    assert got == [(1, 2, 1), (2, 1, 3), (3, 1, 4)]


def test_rank_of_big_integers_nan_and_nulls(spark):
    big = spark.createDataFrame([(2**60 + i,) for i in (0, 1, 2, 1)], "v bigint")
    assert sorted((r.v - 2**60, r["rank"]) for r in global_rank(big, "v").collect()) == [(0, 4), (1, 2), (1, 2), (2, 1)]
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (-0.5,)], "v double")
    for descending in (True, False):
        order = F.col("v").desc() if descending else F.col("v").asc()
        want = {str(r.v): r.r for r in odd.select("v", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
        assert {str(r.v): r["rank"] for r in global_rank(odd, "v", descending=descending).collect()} == want
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    assert sorted((r.v, r["rank"]) for r in global_rank(names, "v", descending=False).collect()) == [
        ("a", 1), ("a", 1), ("b", 3), ("c", 4)]


def test_rank_among_a_larger_population(spark):
    population = spark.createDataFrame([(i, i % 7) for i in range(50)], "id int, v int")
    top = population.orderBy(F.col("v").desc(), "id").limit(9)
    assert {(r.v, r["rank"]) for r in global_rank(top, "v", population=population).collect()} == {(6, 1), (5, 8)}
    plan = global_rank(top, "v", population=population)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exclusive_prefix_many_buckets_equals_running_sum(spark):
    rnd = random.Random(11)
    rows = [(float(i), rnd.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "o double, v long")
    got = {r["o"]: r["v_before"] for r in exclusive_prefix(df, ["o"], ["v"], partitions=7).collect()}
    run, want = 0, {}
    for o, v in rows:
        want[o] = run
        run += v
    assert got == want
    b = range_partitioned(df, ["o"], 7).groupBy("_part").count().collect()
    assert len(b) == 7 and max(r["count"] for r in b) < 250  # balanced


def test_sequential_ids_are_dense(spark):
    df = spark.range(0, 500).withColumn("h", (F.col("id") * 7919) % 1000)
    out = sequential_ids(df, ["h", "id"], out="seq", partitions=5).collect()
    order = sorted(out, key=lambda r: (r["h"], r["id"]))
    assert [r["seq"] for r in order] == list(range(1, 501))


# --- evaluation ----------------------------------------------------------------

def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_roc_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(y, float(rnd.randint(0, 20) + 3 * y)) for y in [rnd.random() < 0.3 for _ in range(300)]]
    rows = [(int(y), s) for y, s in rows]
    df = spark.createDataFrame(rows, "y int, s double")
    a = auc(df, "y", "s").first()
    assert a["auc"] == pytest.approx(_brute_auc(rows), abs=1e-12)
    flipped = auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    assert a["auc"] + flipped == pytest.approx(1.0)
    roc = roc_points(df, "y", "s", partitions=3, drop_intermediate=False).collect()
    tprs = [r["tpr"] for r in roc]
    assert tprs == sorted(tprs) and roc[-1]["tpr"] == 1.0 and roc[-1]["fpr"] == 1.0
    assert roc[0]["threshold"] == float("inf") and roc[0]["tp"] == 0
    roc = roc[1:]
    # trapezoid area of the curve from (0,0) equals the rank statistic
    pts = [(0.0, 0.0)] + [(r["fpr"], r["tpr"]) for r in roc]
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(pts, pts[1:]))
    assert area == pytest.approx(a["auc"], abs=1e-12)


def test_confusion_and_report(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 0)] * 5 + [(0, 1)] * 1
    df = spark.createDataFrame(rows, "y int, p int")
    cm = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in confusion_matrix(df, "y", "p").collect()}
    assert cm == {0: (5, 1), 1: (1, 3)}
    rep = {r["class_name"]: r for r in classification_report(df, "y", "p").collect()}
    assert rep["Fraud"]["precision"] == 0.75 and rep["Fraud"]["recall"] == 0.75
    assert rep["Legitimate"]["precision"] == 5 / 6 and rep["Legitimate"]["support"] == 6
    assert rep["accuracy"]["f1_score"] == 0.8 and rep["accuracy"]["precision"] is None
    assert rep["macro avg"]["recall"] == pytest.approx((5 / 6 + 0.75) / 2)
    none = classification_report(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").collect()
    assert {r["class_name"]: r["precision"] for r in none}["Fraud"] == 0.0  # zero division -> 0


# --- sampling --------------------------------------------------------------------

def test_hash_split_is_repeatable_and_near_fraction(spark):
    df = spark.range(0, 5000).withColumn("cid", F.concat(F.lit("C"), F.col("id").cast("string")))
    a = hash_split(df, "cid").filter("is_test = 1").count()
    b = hash_split(df, "cid").filter("is_test = 1").count()
    assert a == b and 850 < a < 1150
    assert 3500 < hash_sample(df, "cid", 0.75).count() < 4000


def test_exact_stratified_split_sizes(spark):
    df = (spark.range(0, 1003).withColumn("cid", F.col("id").cast("string"))
          .withColumn("y", (F.col("id") % 9 == 0).cast("int")))
    out = exact_stratified_split(df, "cid", "y", 0.2, buckets=64)
    got = {r["y"]: r["n"] for r in out.filter("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1 = 1003 // 9 + 1
    assert got == {0: round(0.2 * (1003 - n1)), 1: round(0.2 * n1)}
    assert out.count() == 1003


# --- data quality ------------------------------------------------------------------

def test_key_violations_and_orphans(spark):
    kids = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", None), (None, "p9")], "k string, pk string")
    dup = {r["k"]: r["n_rows"] for r in key_violations(kids, "k").collect()}
    assert dup == {"b": 2, None: 1}
    parents = spark.createDataFrame([("p1",), ("p1",)], "pk string")
    assert sorted(r["k"] for r in orphans(kids, "pk", parents, "pk").collect()
                  if r["k"] is not None) == ["b"]
    assert orphans(kids, "pk", parents, "pk").count() == 2  # b -> p2 and null -> p9
    rep = orphan_report({"c": kids, "p": parents}, [("c", "pk", "p", "pk")]).first()
    assert rep["n_orphans"] == 2


def test_grouped_sequential_ids_equal_row_number(spark):
    # one group holds most rows; it is still numbered across several buckets
    df = (spark.range(0, 600).withColumn("g", F.when(F.col("id") % 10 < 7, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))))
        .withColumn("h", (F.col("id") * 7919) % 1000))
    got = sequential_ids(df, ["h", "id"], out="seq", partition_by=["g"], partitions=6)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    joined = got.join(want.select("id", "rn"), "id")
    assert joined.filter(F.col("seq") != F.col("rn")).count() == 0 and joined.count() == 600


def _roc_by_hand(rows):
    """The points of the curve: count at every threshold, then drop each inner
    threshold after which the same numbers of both classes come as at it."""
    steps = []
    for t in sorted({x for _, x in rows}, reverse=True):
        steps.append((t, sum(y == 1 and x == t for y, x in rows), sum(y == 0 and x == t for y, x in rows)))
    p, n = sum(s[1] for s in steps), sum(s[2] for s in steps)
    points, tp, fp = [(float("inf"), 0.0, 0.0)], 0, 0
    for i, (t, up, right) in enumerate(steps):
        tp, fp = tp + up, fp + right
        if i in (0, len(steps) - 1) or steps[i + 1][1:] != (up, right):
            points.append((t, fp / n, tp / p))
    return points


@pytest.mark.parametrize("partitions", [None, 1, 4])
def test_roc_drops_points_on_straight_lines(spark, partitions):
    rnd = random.Random(9)
    rows = [(int(rnd.random() < 0.4), float(rnd.randint(0, 30))) for _ in range(400)]
    rows += [(1, 100.0), (1, 101.0), (1, 102.0), (0, -5.0), (0, -6.0)]  # collinear runs
    df = spark.createDataFrame(rows, "y int, s double")
    got = [(r["threshold"], r["fpr"], r["tpr"]) for r in roc_points(df, "y", "s", partitions=partitions).collect()]
    assert got == [pytest.approx(x) for x in _roc_by_hand(rows)]


def test_nan_and_null_scores_take_no_part(spark):
    rows = [(1, float("nan")), (0, 0.1), (1, 0.9), (0, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert auc(df, "y", "s").first()[:] == (1.0, 1, 1)
    assert [r["threshold"] for r in roc_points(df, "y", "s").collect()] == [float("inf"), 0.9, 0.1]
    assert roc_points(df.limit(0), "y", "s").collect() == []
    assert auc(df.limit(0), "y", "s").first()["auc"] is None


def test_confusion_matrix_is_always_two_by_two(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "y int, p int")
    assert [tuple(r) for r in confusion_matrix(df, "y", "p").collect()] == [(0, 1, 2), (1, 0, 0)]
    assert [tuple(r) for r in confusion_matrix(df.limit(0), "y", "p").collect()] == [(0, 0, 0), (1, 0, 0)]


def test_histogram_edges_and_empty_input(spark):
    xs = [1.0, -1.0, -8.15e-305]
    assert [r.n_rows for r in histogram(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 2).collect()] == [2, 1]
    cents = [round(c / 100, 2) for c in range(0, 1001)]  # every bin edge is a value
    got = histogram(spark.createDataFrame([(x,) for x in cents], "x double"), "x", 40).collect()
    counts, edges = np.histogram(np.array(cents), bins=40)
    assert [r.n_rows for r in got] == counts.tolist() and [r.bin_lo for r in got] == edges[:-1].tolist()
    none = spark.createDataFrame([], "k int, x double")
    assert histogram(none, "x", 3, by="k", density=True).columns == ["k", "bin", "bin_lo", "bin_hi", "n_rows", "density"]
    assert histogram(none, "x", 3, by="k").collect() == [] and histogram(none, "x", 3).collect() == []


def test_split_of_a_thousand_classes(spark):
    df = spark.range(0, 10_010).selectExpr("cast(id as string) AS cid", "id % 1001 AS y")
    out = exact_stratified_split(df.withColumn("_n", F.lit(1)), "cid", "y", 0.2)
    assert out.columns == ["cid", "y", "_n", "is_test"]
    per = out.groupBy("y").agg(F.sum("is_test").alias("t"), F.count("*").alias("n"))
    assert {(r.t, r.n) for r in per.collect()} == {(2, 10)} and per.count() == 1001


def test_many_groups_and_repeated_means(spark):
    from claimspark.operators.outliers import ratio_outliers
    df = spark.range(0, 60_000).selectExpr("id", "id % 20000 AS k", "cast(if(id < 20000, 40, 1) AS double) AS x")
    got = ratio_outliers(df, "k", "x", 2)  # each group: 40, 1, 1; mean 14
    assert got.count() == 20_000 and got.filter("ratio != 40 / 14D").count() == 0
    means = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 100.0)], "k bigint, avg_amount double")
    assert sorted(r.id for r in ratio_outliers(df, "k", "x", 2, means=means).collect()) == [1]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_lookup_joins_give_the_same_rows(spark, monkeypatch, limit):
    from claimspark import session
    from claimspark.operators.outliers import group_mean, ratio_outliers
    rnd = random.Random(4)
    rows = [(rnd.choice("abcde"), rnd.randint(0, 1), float(rnd.randint(1, 100))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, c int, x double")
    monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(sys.modules["claimspark.operators.histogram"], "BROADCAST_ROWS", limit)
    mean = {r.k: r.avg_amount for r in group_mean(df, "k", "x").collect()}
    assert sorted((r.k, r.c, r.x) for r in ratio_outliers(df, "k", "x", 1.5).collect()) == sorted(
        r for r in rows if r[2] > 1.5 * mean[r[0]])
    for c in (0, 1):
        got = [r.n_rows for r in histogram(df, "x", 7, by="c").collect() if r.c == c]
        assert got == np.histogram([x for _, k, x in rows if k == c], bins=7)[0].tolist()


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (2, 2), (6, 4), (10, 8), (101, 76)])
def test_exact_sample_has_the_size_of_a_pandas_sample(spark, n, want):
    import pandas as pd

    from claimspark.operators.sampling import exact_sample, hash_sample
    df = spark.createDataFrame([(f"C{i}", i) for i in range(n)], "cid string, x int")
    out = exact_sample(df, "cid", 0.75)
    assert out.columns == ["cid", "x"] and out.count() == want == len(pd.DataFrame({"a": range(n)}).sample(frac=0.75))
    if n == 101:  # the lowest hashes, as the inexact sample takes
        few, many = ({r["cid"] for r in hash_sample(df, "cid", f).collect()} for f in (0.6, 0.9))
        assert few <= {r["cid"] for r in out.collect()} <= many


def test_orphans_are_counted_without_a_join(spark):
    kids = spark.createDataFrame([("a",)] * 4 + [("b",), ("c",), ("c",), (None,)], "k string")
    parents = spark.createDataFrame([("a",), ("a",), ("d",), (None,)], "p string")
    out = orphan_report({"c": kids, "p": parents}, [("c", "k", "p", "p")])
    assert out.first()["n_orphans"] == 3
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_shuffle_the_copies_of_a_row_once(spark):
    """Both sides of the join read the same shuffle: two copies of a row, not one and two."""
    rows = [(i, i % 7, dt.date(2024, 1, 1) + dt.timedelta(days=(i * 13) % 200)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, day date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for symmetric, copies in ((False, 2), (True, 3)):
            pairs = near_pairs(df, ["k"], "id", "day", 1, 30, symmetric=symmetric)
            found = {(r["id_1"], r["id_2"]) for r in pairs.collect()}
            gap = lambda a, b: abs((b - a).days) if symmetric else (b - a).days
            want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and 1 <= gap(a[2], b[2]) <= 30}
            assert found == want and pairs.count() == len(want)
            plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "ReusedExchange" in plan and plan.count("explode(") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
