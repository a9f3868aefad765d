"""The Pfair schedule and the plan against a slot-by-slot simulation."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import pfair_mixing as M


def simulate(shares):
    """[(source, nth, release, deadline)] of one period, slot by slot."""
    s, taken, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    for slot in range(s):
        ready = []
        for name, a in shares.items():
            release, deadline = taken[name] * s // a, -(-(taken[name] + 1) * s // a)
            if release <= slot:
                ready.append((deadline, name, release))
        deadline, name, release = min(ready)
        taken[name] += 1
        out.append((name, taken[name], release, deadline))
    return out


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 7, "b": 2, "c": 1}, {f"s{i:02}": 1 + i * i % 17 for i in range(20)},
                                    {"big": 500, **{f"t{i:02}": 10 for i in range(40)}}])
def test_schedule_keeps_every_source_within_a_block(spark, shares):
    df = spark.createDataFrame(list(shares.items()), "source string, share bigint")
    got = [(r.source, r.nth, r.release, r.deadline) for r in M.schedule(df).orderBy("slot").collect()]
    assert got == simulate(shares)
    total, seen = sum(shares.values()), defaultdict(int)
    for slot, (name, _, release, deadline) in enumerate(got, 1):
        assert release < slot <= deadline
        seen[name] += 1
        for other, a in shares.items():
            assert abs(seen[other] - Fraction(a * slot, total)) < 1


def brute(rows, shares, block):
    """{(doc_id, source): (block, slot)} with documents one after another."""
    period = simulate(shares)
    place = {(n, k): slot for slot, (n, k, _, _) in enumerate(period)}
    size, out = sum(shares.values()), {}
    by = defaultdict(list)
    for i, t, _, source in rows:
        by[source or ""].append((hashlib.md5(str(i).encode()).hexdigest(), i, len(t or "")))
    for source, own in by.items():
        at = 0
        for _, i, n in sorted(own):
            b = at // block + 1
            lap, nth = divmod(b - 1, shares[source])
            out[i] = (source, n, b, lap * size + place[(source, nth + 1)])
            at += n
    return out


def corpus(seed=0, n=300):
    rng = np.random.default_rng(seed)
    return [(i, None if i % 41 == 0 else "x" * int(rng.integers(0, 900)), "en",
             None if i % 50 == 0 else "hot" if rng.random() < .5 else f"s{int(rng.integers(4))}") for i in range(n)]


def test_plan_matches_brute_force(spark, docs):
    rows = corpus() + [(1000, "y" * 50_000, "en", "hot")]
    shares = {"hot": 3, "s0": 2, "s1": 2, "s2": 1, "s3": 5, "": 1}
    df = docs(rows).withColumn("slot", F.lit("x")).withColumn("block", F.lit("x"))
    got = M.plan(df, spark.createDataFrame(list(shares.items()), "source string, share bigint"), block_chars=1000)
    assert {r.doc_id: (r.source, r.size, r.block, r.slot) for r in got.collect()} == brute(rows, shares, 1000)


def test_on_target_ends_where_a_source_lacks_a_block(docs):
    rows = [(i, "x" * 100, "en", "big") for i in range(90)] + [(100 + i, "x" * 100, "en", "few") for i in range(10)]
    got = M.plan(docs(rows), block_chars=100, period=4).collect()
    good = [r for r in got if r.on_target]
    ends = max(r.slot for r in good) + 1
    share = {"big": 3, "few": 1}
    seen = {s: sum(r.source == s for r in good) for s in share}
    for s, a in share.items():
        assert abs(seen[s] - Fraction(a * ends, 4)) < 1
    assert len(got) == 100 and {r.slot for r in good} == set(range(ends))


def test_default_shares_follow_size(docs):
    rows = [(i, "x" * 16, "en", "a") for i in range(4)] + [(9, "x" * 16, "en", "b"), (10, None, "en", "none")]
    shares = {r.source: r.share for r in M.slots_by_size(M.sized(docs(rows)), 0.5, 30).collect()}
    assert shares == {"a": 20, "b": 10, "none": 1}


def test_mixed_keeps_rows_and_deals_stretches(spark, docs):
    df = docs(corpus() + [(7, "again", "en", "s1"), (None, "no id", "en", "s1"), (None, "no id", "en", "s1")])
    df = df.withColumn("slot", F.lit(1)).withColumn("row", F.lit("x"))
    out = M.mixed(df, block_chars=500)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    slot = {r.doc_id: r.slot for r in M.plan(df, block_chars=500).collect() if r.doc_id != 7}
    for part in out.select("doc_id").rdd.glom().collect():
        order = [slot[r.doc_id] for r in part if r.doc_id in slot]
        assert order == sorted(order)


def test_empty_and_repeated(docs):
    assert M.plan(docs([])).collect() == [] and M.mixed(docs([])).collect() == []
    assert M.plan(docs([(1, "a"), (1, "a"), (None, None)])).count() == 3
    assert M.plan(docs([(1, None), (2, "")])).count() == 2


def test_no_python_on_the_main_path(docs):
    df = M.mixed(docs(corpus()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
