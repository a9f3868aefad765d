"""Alignment of two tokenizers against plain set intersection of the token ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import queries, token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return ta.Tokenizers(A, B, 10_000)


def groups(both, text):
    """[(A ids, B ids)] by encoding the whole text, or None."""
    if not text:
        return None
    sides = []
    for ids, table in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text), both.bytes_b)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        sides.append((ids, np.cumsum([len(table[i]) for i in ids]).tolist()))
    common = set(sides[0][1]) & set(sides[1][1])
    out = []
    for ids, ends in sides:
        parts = [[]]
        for i, end in zip(ids, ends):
            parts[-1].append(i)
            if end in common:
                parts.append([])
        out.append(parts[:-1])
    return list(zip(*out))


def digest(found):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found).encode()).hexdigest()


def brute(both, rows):
    """What ``align`` returns for rows (doc_id, text)."""
    all_groups = [groups(both, text) for _, text in rows]
    links = Counter((a[-1], b[-1]) for found in all_groups if found for a, b in found)
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, _), found in zip(rows, all_groups):
        if not found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(a[-1], b[-1]) for a, b in found]
        out.append((doc_id, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(found),
                    sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), digest(found)))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_runs_meet_every_common_end(a, b):
    a, b = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    last = max(a[-1], b[-1]) + 1
    a, b = [*a, last], [*b, last]
    at_a, at_b = ta.aligned(a, b)
    common = sorted(set(a) & set(b))
    assert [a[i] for i in at_a] == common and [b[i] for i in at_b] == common


def test_long_runs_are_jumped():
    a = list(range(1, 100_001))
    b = a[:70_000] + a[70_003:]  # two shifts
    at_a, at_b = ta.aligned(a, b)
    assert len(at_a) == len(b) and (at_a[:70_000] == at_b[:70_000]).all() and (at_a[70_000:] == at_b[70_000:] + 3).all()


def test_units_give_the_ids_of_the_whole_text(both):
    """Random mixtures of white space, controls, special strings and scripts."""
    rng = random.Random(7)
    bits = ["a", "foo", "'s", " ", "  ", "\n", "\t", "\r", " ", "　", "é", "é", "ﬁ", "<|endoftext|>", "<s>", "<0x41>",
            "▁", "2024", ".", "!!", "世", "😀", "​", "\x00", "\x1c", "\x85", "The", "<unk>", "﻿", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        found, want = ta.align_texts(both, [text.encode()], block_units=rng.choice([1, 3, 100]))[0], groups(both, text)
        if want is None:
            assert found.bad
        else:
            assert (found.n_a, found.n_b, found.groups, found.digest.hexdigest()) == (
                sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), digest(want))


def test_a_cleared_cache_changes_nothing(both):
    small = ta.Tokenizers(A, B, 5)
    texts = [f"word{i} and word{i + 1}\nagain".encode() for i in range(200)]
    keep = [t.digest.hexdigest() for t in ta.align_texts(both, texts)]
    assert [t.digest.hexdigest() for t in ta.align_texts(small, texts, block_units=7)] == keep
    assert len(small.places) < 30


ROWS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "the cat sat on the mat"), (5, "naïve café déjà vu"),
        (5, "one id twice"), (None, "no id"), (6, "a ▁ sign"), (7, "x <|endoftext|> y <s>"), (8, " "), (9, "\n\n"), (10, "the the the the")]


@pytest.mark.parametrize("head", [1 << 19, 5, 0])
def test_counts_and_defined_cases(spark, docs, both, head):
    df = ta.align(docs(ROWS).repartition(4), A, B, head_pairs=head)
    assert df.columns == COLUMNS
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(both, ROWS)


def test_empty_table_extra_columns_and_a_very_long_text(spark, docs, both):
    assert ta.align(docs([]), A, B).count() == 0
    long = " ".join(f"passage {i} of the text," for i in range(60_000))
    rows = [(1, long), (2, "the text"), (3, "x" * 200_000)]
    names = "doc_id bigint, text string, uid string, a int, n_a string, key string"
    df = ta.align(spark.createDataFrame([(*r, "u", 1, "z", "k") for r in rows], names), A, B, head_pairs=50)
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(both, rows)


def test_query_matches_brute_force(spark, both):
    df = queries.op13_token_alignment(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(both, rows)
