"""Trees after edits against counting the edited text anew."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspark.llm import edit_counts as E

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WHOLE.encode_special_tokens = True


def full(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return E.counter(PATH, PATTERN)


def random_text(rng, n):
    parts = list("ab é漢1 2  \n\n\t\t'#!.,") + ["the ", " don't", "   ", " ", "'s", "'ll ", "word ", "12345"]
    return "".join(rng.choice(parts, n))


def test_random_edits_keep_the_count(own):
    rng = np.random.default_rng(0)
    for round_ in range(150):
        text = random_text(rng, int(rng.integers(0, 600)))
        tree = E.TokenTree.of(text, own)
        assert tree.tokens == full(text)
        for _ in range(6):
            a = int(rng.integers(0, len(text) + 1))
            b = min(len(text), a + int(rng.integers(0, 40)))
            tree, text = E.edit(tree, text, a, b, random_text(rng, int(rng.integers(0, 12))), own)
            assert tree.tokens == full(text)
            assert tree.leaf_rows()[:, 0].sum() == len(text)
            for node in range(1, tree.base):
                assert (tree.sums[node] == tree.sums[2 * node] + tree.sums[2 * node + 1]).all()


def test_long_runs_and_borders(own):
    for text in (" " * 9000 + "x", "a" * 5000, "\n" * 300 + " a" * 300, "x " * 5000):
        for a, b, new in ((0, 1, ""), (len(text) - 1, len(text), " "), (len(text), len(text), "end"),
                          (len(text) // 2, len(text) // 2 + 3, "q"), (0, len(text), "")):
            tree, after = E.edit(E.TokenTree.of(text, own), text, a, b, new, own)
            assert after == text[:a] + new + text[b:] and tree.tokens == full(after)


def test_an_edit_encodes_a_small_region(own):
    text = "some words of a long document here. " * 3000
    tree = E.TokenTree.of(text, own)
    seen = own.encoded
    tree, after = E.edit(tree, text, 50_000, 50_010, "replaced", own)
    assert own.encoded - seen < 1500 and tree.tokens == full(after)


def test_redaction_counts_match_brute_force(docs):
    rng = np.random.default_rng(1)
    rows = [(i, f"Mail {i} me.{i}@ex-ample.org or +1 (555) 0100-2{i:03} now. " * int(rng.integers(0, 9)) +
             random_text(rng, 200)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a@b.co"), (None, "12345678 90"), (3, "again"), (103, "<|endoftext|> x@y.zz")]
    got = E.edited_counts(docs(rows).withColumn("n_tokens", F.lit("x")), PATH, PATTERN).collect()
    want = []
    for i, t in rows:
        t = t or ""
        after, edits = t, E.redactions(t)
        for a, b, new in sorted(edits, reverse=True):
            after = after[:a] + new + after[b:]
        want.append((i, len(t), full(t), len(edits), len(after), full(after)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert E.edited_counts(docs([]), PATH, PATTERN).collect() == []


def test_stored_trees_take_edits(spark, docs):
    rows = [(1, "one two three four " * 40), (2, None), (3, "untouched"), (4, "tail")]
    trees = E.build(docs(rows), PATH, PATTERN)
    edits = spark.createDataFrame(
        [(1, [(0, 3, "1"), (2, 7, "xx"), (100, 99, "in"), (5000, 6000, " end")]), (2, [(0, 0, "new text")]), (4, None)],
        "doc_id bigint, edits array<struct<start:bigint,end:bigint,new:string>>")
    got = {r.doc_id: r for r in E.apply_edits(docs(rows), trees, edits, PATH, PATTERN).collect()}
    text = rows[0][1]
    assert got[1].text == "1" + "xx" + text[7:100] + "in" + text[100:] + " end"
    assert got[2].text == "new text" and got[4].text == "tail" and 3 not in got
    for r in got.values():
        assert r.n_tokens == full(r.text) == sum(r.tokens) and sum(r.chars) == len(r.text)
