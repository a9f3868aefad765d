"""Incremental key and reference checks against the full reports."""

import numpy as np
import pytest

from claimspark import operators as ops
from claimspark.operators import key_index as ki


def full(df, keys):
    return tuple(ops.key_report({"t": df}, {"t": keys}).first())


@pytest.mark.parametrize("exact", [True, False])
def test_batches_match_the_full_report(spark, monkeypatch, exact):
    if not exact:  # the Bloom filter instead of a broadcast of the keys
        reduce = ki.reduce_by_keys
        monkeypatch.setattr(ki, "reduce_by_keys", lambda *a: reduce(*a, exact_up_to=2))
    monkeypatch.setattr(ki, "MAX_SEGMENTS", 2)
    rng = np.random.default_rng(2)
    data = [(int(a) if a else None, f"x{b}") for a, b in zip(rng.integers(0, 40, 200), rng.integers(0, 4, 200))]
    schema, index, seen = "a bigint, b string", ki.KeyIndex(["a", "b"]), []
    for part in (data[:60], data[60:61] * 3, [], data[61:150], data[150:]):
        batch = spark.createDataFrame(part, schema)
        out = {(r["a"], r["b"]): (r["n_before"], r["n_batch"]) for r in index.add(batch).collect()}
        want = {}
        for key in set(part):
            before, now = seen.count(key), part.count(key)
            if before + now > 1 or key[0] is None:
                want[key] = (before, now)
        assert out == want
        seen += part
        whole = spark.createDataFrame(seen, schema)
        assert tuple(index.report(whole, "t").first()) == full(whole, ["a", "b"])
    assert len(index.segments) <= 3


def test_one_key_with_most_rows_and_a_single_column(spark):
    index = ki.KeyIndex("k")
    for part in ([(1,)] * 500 + [(2,)], [(1,)] * 300 + [(3,)], [(2,)]):
        index.add(spark.createDataFrame(part, "k int"))
    assert (index.violating_keys, index.violating_rows) == (2, 802)


def test_orphans_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(ki, "MAX_SEGMENTS", 2)
    parent, child = "p string", "c string, n int"
    steps = [("c", ["a", "b", "b", None]), ("p", ["a", "x"]), ("c", ["a", "z", "b"]), ("p", ["z", None, "z"]), ("c", ["q"] * 5),
             ("p", ["b"]), ("c", ["x", "y"]), ("p", ["q2"]), ("c", ["z"])]
    index, parents, children = ki.ReferenceIndex("c", "p"), [], []
    assert index.orphans() == 0
    for kind, values in steps:
        if kind == "p":
            index.add_parents(spark.createDataFrame([(v,) for v in values], parent))
            parents += values
        else:
            missing = {r["key"]: r["n"] for r in index.add_children(spark.createDataFrame([(v, 1) for v in values], child)).collect()}
            assert missing == {v: values.count(v) for v in set(values) if v is not None and v not in parents}
            children += values
        want = ops.orphan_count(spark.createDataFrame([(v,) for v in children], "c string"), "c",
                                spark.createDataFrame([(v,) for v in parents], "p string"), "p").first()[0]
        assert index.orphans() == want


def test_a_batch_is_written_once(spark, monkeypatch):
    """Neither the keys wanted of the segments nor those met are stored again."""
    from claimspark.operators import semijoin
    names = []
    for module in (ki, semijoin):
        monkeypatch.setattr(module, "stored", lambda df, name, own=module.stored: (names.append(name), own(df, name))[1])
    index = ki.KeyIndex("k")
    for part in ([(1,), (2,)], [(2,), (3,), (None,)], [(3,)]):
        index.add(spark.createDataFrame(part, "k int"))
    assert names == ["key-batch"] * 3
    assert (index.violating_keys, index.violating_rows) == (3, 5)
