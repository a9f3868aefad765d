"""Hard-negative mining against plain Python over every pair."""

import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import queries, strassen_mining as sm

SCHEMA = "vec_id bigint, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def brute(rows, every, relabel_every=0, positives=5, negatives=10, scale=256):
    """rows: (id, vector, label) that take part."""
    def whole(v):
        return [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]

    most = (1 << 63) - 1
    rows = [(i, whole(v), (lab + 1) % 10 if relabel_every and i % relabel_every == 0 else lab) for i, v, lab in rows]
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(va, v)))), i, lab) for i, v, lab in rows if i != a)
        for place, (ps, pid, _) in enumerate([s for s in scored if s[2] == la][:positives], 1):
            inside = [(n, i) for n, i, lab in scored if lab != la and -30 * ps <= -100 * n <= -90 * ps][:negatives]
            out += [(a, pid, r, i, -ps, -n, place) for r, (n, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in sm.mine(df, **kw).collect())


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 150), st.integers(1, 150), st.integers(1, 150), st.integers(0, 1 << 30))
def test_strassen_is_the_product(n, k, m, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-1 << 24, 1 << 24, (n, k)), rng.integers(-1 << 24, 1 << 24, (k, m))
    assert (sm.strassen(a, b) == a @ b).all()


def test_strassen_wraps_on_the_way_and_comes_back():
    a = np.full((64, 64), 1 << 30)
    a[:, 1::2] *= -1  # every product of 64 pairs is zero, partial sums leave 64 bits
    b = np.full((64, 64), 1 << 32)
    assert (sm.strassen(a, b) == 0).all()


@pytest.mark.parametrize("value", [0.0, -1.0, 3.5, 1e9, -1e12, 3e38, -1e300, 1.5e308])
def test_limbs_add_up_to_the_component(value):
    exact = int(np.floor(value * 256)) if abs(value) < 1e300 else int(value) * 256
    parts = sm.limbs(np.array([[value]]), 256)
    assert sum(int(p[0, 0]) << (sm.LIMB * i) for i, p in enumerate(parts)) == exact


def test_heaps_keep_the_best_with_ties_to_smaller_ids():
    rng = np.random.default_rng(3)
    heaps, held = sm.Heaps(7, 4), [[] for _ in range(7)]
    for _ in range(12):
        score = rng.integers(-5, 6, (7, 9))
        score[rng.random((7, 9)) < 0.3] = sm._NONE
        ids = rng.permutation(1000)[:9]
        heaps.add(0, score, ids)
        for i in range(7):
            held[i] += [(-int(s), int(x)) for s, x in zip(score[i], ids) if s != sm._NONE]
    row, found, score = heaps.entries()
    for i in range(7):
        assert [(-int(s), int(x)) for r, x, s in zip(row, found, score) if r == i] == sorted(held[i])[:4]


def test_random_vectors_match_every_pair(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * 0.4], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)]  # ties
    want = brute(rows, every=20, relabel_every=7)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(5), every=20, relabel_every=7)
    assert got == want and len(want) > 200
    # several blocks of anchors, and tiles smaller than the table
    small = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20, relabel_every=7, block_bytes=4000)
    assert small == want


def test_defined_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, None, 1), (5, [nan, 1.0], 1),
            (6, [1.0, None], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (8, [float("inf"), 0.0], 2), (9, [1.0], 2)]
    good = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (9, [1.0, 0.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA), every=100) == brute(good, 100)
    empty = sm.mine(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    assert empty.count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)  # an anchor without positives
    assert sm.mine(alone).count() == 0
    clash = spark.createDataFrame([(*r, 7, "x", 1) for r in good], SCHEMA + ", id int, v string, ok int")
    assert mined(clash, every=100) == brute(good, 100)


def test_repeated_ids_are_one_anchor_and_each_a_candidate(spark):
    rows = [(0, [1.0], 1), (0, [2.0], 1), (1, [2.0], 1), (1, [2.0], 1), (2, [1.0], 2), (2, [1.0], 2)]
    got = mined(spark.createDataFrame(rows, SCHEMA), every=100)
    # the anchor is [1.0]; id 1 is its positive twice, id 2 a negative of each twice
    s, n = 2 * 256 * 256, 256 * 256
    assert got == sorted((0, 1, rank, 2, s, n, place) for place in (1, 2) for rank in (1, 2))


def test_large_components_are_exact(spark):
    big = [(0, [1e9, 1.0], 1), (1, [1e9, 3.0], 1), (2, [6e8, 0.0], 2), (3, [6e8, 5.0], 2), (4, [1.0, 1.0], 2)]
    assert mined(spark.createDataFrame(big, SCHEMA), every=100) == brute(big, 100)
    huge = [(0, [-1e30, 1.0], 1), (1, [1e12, 1.0], 1), (2, [-1e12, 2.0], 1), (3, [-4e11, 0.0], 2), (4, [1e-3, 0.0], 2)]
    assert mined(spark.createDataFrame(huge, SCHEMA), every=100) == brute(huge, 100)


@pytest.mark.skipif(not os.path.exists(SF), reason="testdata not present")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    cur = con.execute(queries.ORACLE["op11_hard_negatives"])
    names = [d[0] for d in cur.description]
    df = queries.op11_hard_negatives(spark, SF)
    assert df.columns == names
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and want
