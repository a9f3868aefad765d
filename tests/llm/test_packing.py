"""Round trips of the packed pieces and of the word cache."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspark.llm import packing as K
from claimspark.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


ODD = ["", "a", "It's the End. 'tis IT'S", "x\x01y \x01 z", "<|endoftext|> in <|startoftext|>text", "é́ é ́",
       "漢字かな交じり文", "a\xa0b　c\x1cd\x85e", "ÅÉÎ ΑΣ ΑΣ. İ", "12 345 6,7", "\n\n \t\x0b\x0c", "🙂🙂 ok", "w" * 5000]


def test_every_latin_letter_and_sign():
    chars = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)]]
    words = chars + [a + b for a in "aÀé'9-ß" for b in chars] + ["Ünïcödé's", "L'ÉTÉ,", "straße", "ÿÞþÐð", "naïve'll", "x­y"]
    got = WordEncoder(PATH).encode([w.encode() for w in words])
    for w, ids in zip(words, got):
        assert ids.tolist() == ids_of(w), w
    joined = " ".join(words)
    assert WordEncoder(PATH).encode([joined.encode()])[0].tolist() == ids_of(joined)


def test_word_cache_gives_the_tokenizer_s_ids():
    small = WordEncoder(PATH, generation=5)
    for _ in range(3):
        for t in ODD:
            assert small.encode([t.encode()])[0].tolist() == ids_of(t), t
    assert [x.tolist() for x in WordEncoder(PATH).encode([t.encode() for t in ODD])] == [ids_of(t) for t in ODD]


def check(rows, pieces, tiers=K.TIERS):
    """Every id once, sequences gapless; returns padded share."""
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*ids_of(t), K.END_ID], "<u4"))
    for i, texts in want.items():
        assert sorted(sum((len(x) for x in texts), 0) for _ in [0]) == [sum(p.length for p in by[i])]
        if len(texts) == 1:
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                assert p.ids_crc32 == zlib.crc32(texts[0][at:at + p.length].tobytes())
                at += p.length
    used = padded = 0
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tiers[0] and len({(p.tier, p.step_group) for p in own}) == 1
        used += at
        padded += 0 if at & (at - 1) == 0 else tiers[0] - at
    return padded, used


def corpus(n=200, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghé"), int(rng.integers(1, 9)))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, int(rng.lognormal(5, 1))))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " ".join(rng.choice(words, 30_000)))]


@pytest.mark.parametrize("pool", [3_000, 1 << 21])
def test_every_id_lies_in_one_piece(docs, pool):
    rows = corpus()
    df = docs(rows).withColumn("start", F.lit(1)).coalesce(1)
    padded, used = check(rows, K.pack(df, PATH, pool_tokens=pool).collect())
    assert used > 100_000 and padded < K.TIERS[0]


def test_small_inputs(docs):
    assert K.pack(docs([]), PATH).collect() == []
    rows = [(1, None), (2, ""), (None, "one two"), (1, "again")]
    check(rows, K.pack(docs(rows), PATH).collect())


def test_packer_fills_windows_and_balances_steps():
    rng = np.random.default_rng(3)
    packer = K.Packer(step_tokens=1 << 14, pool_tokens=1 << 18)
    sizes = [int(x) for x in rng.lognormal(6, 1.2, 4000)]
    for i, n in enumerate(sizes):
        packer.add(i, n)
    packer.finish()
    assert sum(p[0] for _, _, w in packer.out for p in w) == sum(sizes)
    assert sum(sum(p[0] for p in w) != t for t, _, w in packer.out) <= 1
    steps = defaultdict(list)
    for tier, group, window in packer.out:
        steps[group].append((tier, sum(p[0] ** 2 for p in window)))
    full = [s for s in steps.values() if len(s) * s[0][0] == 1 << 14]
    assert all(len({t for t, _ in s}) == 1 for s in steps.values()) and len(full) > .8 * len(steps)
    cost = [sum(c for _, c in s) for s in full if s[0][0] == 1024]
    assert max(cost) < 2 * min(cost)
