"""Exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import exact_topk as K

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, every=20, scale=64):
    ok = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, qv in asked.items():
        found = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, K.top_k(df.withColumn("score", F.lit("x")).withColumn("id", F.lit("x")), **kw).collect()))


def random_rows(n=400, dims=24, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, spread, dims)]) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"k": 3, "every": 7}, {"block_bytes": 400}, {"every": 1}, {"scale": 1000}, {"k": 1}])
def test_matches_brute_force(spark, kw):
    rows = random_rows()
    args = {a: b for a, b in kw.items() if a != "block_bytes"}
    assert run(spark, rows, **kw) == brute(rows, **args)


@pytest.mark.parametrize("spread", [300.0, 3e6])
def test_large_components_stay_exact(spark, spread):
    rows = random_rows(120, 8, 1, spread)
    assert run(spark, rows) == brute(rows)


def test_ties_and_copies(spark):
    rows = [(i, [0.5, -0.25, 0.1]) for i in range(90)] + [(100 + i, [0.0, 0.0, 0.0]) for i in range(50)]
    assert run(spark, rows) == brute(rows)
    negative = [(i, [1.0, 1.0] if i % 20 == 0 else [-1.0, -0.5 * (i % 3)]) for i in range(60)]
    assert run(spark, negative) == brute(negative)


def test_defined_cases(spark):
    rows = random_rows(60, 4) + [(60, None), (61, []), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (80, [1.0]),
                                 (64, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (20, [0.1] * 4), (65, [1.0, 2.0]),
                                 (7, [0.3] * 4), (7, [0.3] * 4), (100, [2.0] * 6)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == [] and run(spark, [(3, [1.0])]) == []
    assert run(spark, [(20, [1.0]), (1, [0.5])]) == [(20, 1, 1, 64 * 32)]


@pytest.mark.parametrize("parts", [1, 5])
def test_few_large_vectors_are_all_returned(spark, parts):
    """With fewer than k candidates there is no cutoff, also where scores need int64."""
    rows = random_rows(9, 8, 2) + [(20, [1e6] + [0.5] * 7), (40, [-1e6] * 8), (11, [1e6] * 8)]
    got = run(spark, rows, parts)
    assert len(got) == 3 * 11 and got == brute(rows)


def test_components_of_any_size(spark):
    """1e9 leaves 64 bits, 1e12 leaves them in every product, -1e30 has no long."""
    rng = np.random.default_rng(4)
    for sizes in ([1e9, -1e9], [1e12, -1e12, 1.0], [-1e30, 1e30, 1e3], [1e9, 1e-2]):
        rows = [(int(i), [float(np.float32(x)) for x in rng.choice(sizes, 5) * rng.normal(size=5)]) for i in range(60)]
        got = sorted(tuple(r) for r in K.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=5, every=20).collect())
        whole = {i: [int(np.floor(x * 64)) for x in v] for i, v in rows}
        want, most = [], (1 << 63) - 1
        for q in range(0, 60, 20):
            scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
        assert got == sorted(want)
