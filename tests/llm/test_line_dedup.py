"""Line dedup against brute force; the index under inserts and deletions."""

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from claimspark.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def norm(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs, min_chars):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(norm(line)) >= min_chars:
                held[norm(line)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = lines if i is None else [x for x in lines if keeper.get(norm(x), i) == i]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    common = [f"Shared passage number {j} " + "é" * 20 for j in range(8)]
    rows = []
    for i in range(n):
        lines = [str(rng.choice(common)) if rng.random() < .5 else f"own line {i} {j} " + "x" * 40 for j in range(5)]
        lines = [x.upper() if rng.random() < .2 else f" \t{x}\r" if rng.random() < .2 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def report(df, **kw):
    return sorted((tuple(r) for r in L.dedup_report(df, **kw).collect()), key=str)


def test_matches_brute_force(docs):
    rows = corpus() + [(100, None), (101, ""), (102, "\n\n"), (103, "a" * 100_000 + "\n" + corpus()[0][1])]
    assert report(docs(rows), min_docs=5, min_chars=40) == brute(rows, 5, 40)
    assert report(docs(rows), min_docs=2, min_chars=10) == brute(rows, 2, 10)


def test_null_repeated_and_missing_rows(docs):
    line = "the same long line in every one of these documents"
    rows = [(i, line) for i in range(5)] + [(4, line), (4, line), (None, line), (None, line)]
    assert report(docs(rows)) == brute(rows, 5, 40)
    rows = [(1, line)] * 6  # one document, however often its row repeats
    assert report(docs(rows)) == brute(rows, 5, 40)
    assert report(docs([])) == []


def test_code_points_decide_the_length(docs):
    for text, long in (("é" * 39, False), ("é" * 40, True), (" " * 50 + "é" * 39, False)):
        rows = [(i, text) for i in range(5)]
        assert (report(docs(rows)) == brute(rows, 5, 40)) and (sum(r[2] for r in report(docs(rows))) > 0) == long


def test_other_columns_pass_through(docs):
    df = docs(corpus()).withColumn("k1", F.lit("mine")).withColumn("keeper", F.lit(1.5))
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, L.N_LINES, L.N_DROPPED]
    assert out.filter("k1 = 'mine' AND keeper = 1.5 AND lang = 'en'").count() == 60


def state(index):
    return (sorted(map(tuple, index.refs.distinct().collect())), sorted(map(tuple, index.counts.collect())),
            sorted((r.doc_id, sorted(zip(r.k1, r.k2))) for r in index.drops().collect()))


def test_insert_then_delete_restores_the_index(docs):
    first, second = corpus(0, 40), [(i + 1000, t) for i, t in corpus(1, 30)]
    built = L.LineIndex.build(docs(first), keys_per_shard=3)
    assert built.shards > 1
    grown = built.insert(docs(second))
    assert state(grown) == state(L.LineIndex.build(docs(first + second)))
    again = grown.insert(docs(second))
    assert state(again) == state(grown)
    back = grown.delete(docs(second).select("doc_id"))
    assert state(back) == state(built)
    small = built.delete(docs(first[:37]).select("doc_id"))
    assert state(small)[2] == state(L.LineIndex.build(docs(first[37:])))[2] == []


def test_filters_in_blocks_give_the_same_drops(docs):
    one = L.LineIndex.build(docs(corpus()), keys_per_shard=1)
    many = L.LineIndex.build(docs(corpus()), keys_per_shard=1, block_bytes=10)
    assert state(one) == state(many)


def test_cuckoo_filter_holds_inserts_and_forgets_deletes():
    rng = np.random.default_rng(2)
    k = rng.integers(-2**63, 2**63 - 1, (6000, 2))
    f = L.Cuckoo.sized(3000)
    f.insert(k[:3000, 0], k[:3000, 1])
    f = L.Cuckoo.load(*f.dump())
    assert f.holds(k[:3000, 0], k[:3000, 1]).all()
    assert f.holds(k[3000:, 0], k[3000:, 1]).mean() < .01
    f.delete(k[:1500, 0], k[:1500, 1])
    assert f.holds(k[1500:3000, 0], k[1500:3000, 1]).all()
    assert f.holds(k[:1500, 0], k[:1500, 1]).mean() < .01
    tight = L.Cuckoo(np.zeros((4, 4), np.uint16), set())  # 16 places: the rest is stashed, none is lost
    tight.insert(k[:40, 0], k[:40, 1])
    assert tight.stash and tight.holds(k[:40, 0], k[:40, 1]).all()
    tight.delete(k[:40, 0], k[:40, 1])
    assert not tight.stash and not tight.cells.any()
