"""Counts against plain Python, sketches against exact quantiles."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimspark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    seen = Counter(grams)
    covered = {i + s for i, g in enumerate(grams) if seen[g] > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def odd_texts():
    rng = np.random.default_rng(0)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c a b c", "é ñ 漢字 é ñ 漢字 é", "x\x0by\x0cz\rq\tw",
           "x y z", "## $ %% a|b <c>", "l\nl\n\n \nl \nl", "w" * 200_000, "a b c " * 9000, "a b\x1cc"]
    for _ in range(40):
        out.append("".join(rng.choice(list("ab é#\n\t ") + ["漢"], 300)))
    return out


def test_counts_match_plain_python(docs):
    texts = odd_texts()
    got = {r.doc_id: r for r in Q.report(docs(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:50]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_slices_do_not_change_counts():
    texts = [(t or "").encode() for t in odd_texts()]
    whole = Q.count_slice(pa.array(texts, pa.binary()))
    for i, t in enumerate(texts):
        one = Q.count_slice(pa.array([t], pa.binary()))
        assert {k: v[0] for k, v in one.items()} == {k: v[i] for k, v in whole.items()}


def prose(rng, symbols=0):
    return " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) + "#" * symbols for _ in range(80))


def test_thresholds_follow_the_group(docs):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng), "en", "a") for i in range(60)]
    rows += [(100 + i, prose(rng, 1), "code", "b") for i in range(60)]  # symbols are usual here
    rows += [(200, prose(rng, 1), "en", "a"), (201, prose(rng, 3), "code", "b"), (202, prose(rng), "en", None)]
    kept = {r.doc_id: r.kept for r in Q.report(docs(rows), min_group=20).collect()}
    assert all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))
    assert not kept[200] and not kept[201] and kept[202]


def test_sketches_merge_and_bound_the_error(docs, spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(0, 4))), "en", f"s{i % 3}") for i in range(90)]
    measured = Q.measure(docs(rows), ["lang", "source"])
    q = {r.metric: r for r in Q.quartiles(Q.merged(Q.sketches(measured))).collect()}
    for metric in ("symbols_per_word", "word_length"):
        exact = sorted(r[0] for r in measured.select(Q.ratio(metric)).collect())
        for name, p in (("q25", .25), ("q50", .5), ("q75", .75)):
            want = exact[int(np.ceil(p * 90)) - 1]
            assert abs(q[metric][name] - want) <= Q.ALPHA * want + Q.TINY
        assert q[metric].n == 90


def test_keep_returns_the_rows_unchanged(docs):
    rng = np.random.default_rng(3)
    df = docs([(1, prose(rng)), (1, prose(rng)), (None, prose(rng)), (2, None), (3, "short")])
    df = df.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(None).cast("int"))
    out = Q.keep(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert sorted(map(str, out.collect())) == sorted(map(str, df.filter("length(text) > 9").collect()))
    assert Q.keep(docs([])).collect() == [] and Q.report(docs([])).collect() == []


def test_each_limit_rejects_what_the_base_rules_pass(docs):
    """A clean group: one odd document for each of the four ratios, clean ones stay."""
    rng = np.random.default_rng(7)

    def lines(n=12):
        return [prose(rng)[:40] for _ in range(n)]

    clean = [(i, "\n".join(lines()), "en", "a") for i in range(80)]
    body = lines()
    half = "\n".join(x for line in body for x in (line, "menu"))  # nearly half of the lines repeat, no passage does
    parts = prose(rng).split()
    passage = parts[:18]
    repeats = " ".join(parts[18:60] + passage + parts[60:62] + passage)  # 45 % in repeated windows
    odd = {"symbols_per_word": prose(rng, 1), "dup_line_share": half, "repeat_share": repeats,
           "word_length": " ".join("x" * 14 for _ in range(1)) + " " + " ".join(w + "abcdefgh" + str(i) for i, w in enumerate(parts))}
    rows = [*clean, *((100 + i, t, "en", "a") for i, t in enumerate(odd.values()))]
    got = {r.doc_id: r for r in Q.report(docs(rows), min_group=20).collect()}
    assert all(got[i].kept for i in range(80))
    for i, metric in enumerate(odd):
        assert not got[100 + i].base_failed and not got[100 + i].kept, metric
    assert 100 * got[102].n_repeat_words > 40 * got[102].n_words and got[101].n_dup_lines == 11


def test_limits_widen_with_the_group(docs):
    """The same share of repeated lines is usual in one source and rejected in another."""
    rng = np.random.default_rng(8)

    def page(menus):
        body = [prose(rng)[:40] for _ in range(10)]
        return "\n".join(x for i, line in enumerate(body) for x in ([line, "menu"] if i < menus else [line]))

    rows = [(i, page(0), "en", "clean") for i in range(60)] + [(100 + i, page(i % 9), "en", "lists") for i in range(60)]
    rows += [(200, page(10), "en", "clean"), (201, page(10), "en", "lists")]
    kept = {r.doc_id: r.kept for r in Q.report(docs(rows), min_group=20).collect()}
    assert not kept[200] and kept[201] and all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))


def test_a_very_long_text_takes_little_memory():
    """Sliced hashing gives the keys of the whole, in a few bytes a byte of text."""
    import tracemalloc
    rng = np.random.default_rng(9)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60_000)).encode() * 24  # 10 MB
    column = pa.array([text], pa.binary())
    tracemalloc.start()
    got = Q.count_slice(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_words"][0] == len(text.split()) and got["word_chars"][0] == len(text) - text.count(b" ")
    assert peak < 30 * len(text)
