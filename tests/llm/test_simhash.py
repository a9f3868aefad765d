"""SimHash groups against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from claimspark.llm import simhash_pigeonring as S


def brute(texts, k, max_bits):
    """{doc_id: (fingerprint, component)} by plain counting and all pairs."""
    fps = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[j:j + k]) for j in range(max(1, len(words) - k + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= max_bits and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def texts(seed=3, groups=12):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, i = {}, 0
    for _ in range(groups):
        base = list(rng.choice(vocab, 150))
        for _ in range(int(rng.integers(1, 9))):
            one = list(base)
            for _ in range(int(rng.integers(0, 6))):
                one[int(rng.integers(len(one)))] = str(rng.choice(vocab))
            out[i] = " ".join(one).title()
            i += 1
    out.update({i: None, i + 1: "", i + 2: " \t\n", i + 3: "One two", i + 4: "one TWO", i + 5: "é É ñ"})
    return out


@pytest.mark.parametrize("max_bits,bucket_rows", [(4, 20_000), (4, 3), (3, 2), (6, 20_000), (1, 20_000)])
def test_components_match_brute_force(spark, docs, max_bits, bucket_rows):
    t = texts()
    got = S.near_duplicates(docs(t.items()), 4, max_bits, bucket_rows).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute(t, 4, max_bits)


def test_ring_masks_cover_every_pattern():
    rng = np.random.default_rng(1)
    for max_bits in (2, 3, 4, 5):
        segs = S.segments(max_bits)
        for exact in range(1, max_bits + 1):
            masks = [(s, sum(segs[f] for f in free)) for s, free in S.ring_masks(max_bits, exact)]
            chains = S._Chains(max_bits)
            for _ in range(300):
                xor = 0
                for b in rng.choice(64, int(rng.integers(0, max_bits + 1)), replace=False):
                    xor |= 1 << int(b)
                met = [s for s, m in masks if xor & m == 0]
                assert any(len(chains.keep(np.array([xor], np.uint64), np.array([s]))) for s in met)


def test_bucket_forest_connects_like_all_pairs():
    rng = np.random.default_rng(5)
    chains = S._Chains(4)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(centre ^ np.array([sum(1 << int(b) for b in rng.choice(56, int(rng.integers(0, 5)), replace=False)) << 8
                                       for _ in range(300)], np.uint64))
    a, b = S.bucket_links(np.zeros(len(fps), int), np.zeros(len(fps), int), fps, chains)
    assert len(a) <= len(fps) - 1
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 4
        root[find(x)] = find(y)
    for i, x in enumerate(fps):
        hit = chains.keep(fps ^ x, np.zeros(len(fps), int))
        assert {find(int(f)) for f in fps[hit]} == {find(int(x))}


def test_defined_cases(spark, docs):
    df = docs([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "other words entirely here now"),
               (9, None)])
    rows = S.near_duplicates(df.withColumn("fp", df.text).withColumn("component_id", df.text)).collect()
    assert len(rows) == 5
    assert {r.component_id for r in rows if r.doc_id in (5, None)} == {5}
    assert [r.fingerprint for r in rows if r.doc_id == 9] == ["0" * 16]
    assert S.near_duplicates(docs([])).collect() == []
    kept = S.keep_one(docs([(1, "x y z w v"), (2, "x y z w v"), (None, "x y z w v"), (3, "q r s t u")])).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"]


def test_a_giant_component_is_split_in_the_last_join(spark, docs):
    """With a low threshold adaptive execution splits the join that names the components."""
    rows = [(i, f"one two three four five {i // 400}") for i in range(1200)] + [(5000 + i, f"text number {i} of its own kind") for i in range(50)]
    df = S.near_duplicates(docs(rows), 4, 4)
    got = {}
    for r in df.collect():
        got.setdefault(r.component_id, set()).add(r.doc_id)
    assert len(got[0]) >= 400
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0  # both sides of every remaining join are tables
