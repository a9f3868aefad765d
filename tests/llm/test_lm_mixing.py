"""Base scores against plain counting; the mixer as a probability model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import lm_mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def out(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1


def brute(rows):
    counts = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return {i: (out(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n,
                sum(math.log10((counts[t] + .5) / (n + .5 * (v + 1))) for t in tokens(x))) for i, x in rows}


def corpus(n=150, seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghéÀ"), int(rng.integers(1, 7)))) for _ in range(400)]
    p = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 200)), p=p / p.sum())).title()) for i in range(n)]
    same = "a passage that is found in many of the documents word by word "
    rows = [(i, t + "\n" + same * 3 if i % 4 == 0 else t) for i, t in rows]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\x0b"), (n + 3, "x" * 9000 + " y\x1cz " * 500)]


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_base_matches_plain_counting(docs, head):
    rows = corpus()
    df = docs(rows).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x"))
    got = {r.doc_id: r for r in M.score(df, head_words=head).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and (r.bits_per_byte is None) == (not dict(rows)[i])


def test_context_beats_the_base_on_unseen_texts(docs):
    rows = corpus(400)
    got = M.score(docs(rows)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * .97


def test_scores_do_not_depend_on_the_partitioning(docs):
    rows = corpus(80)
    one, many = (sorted((r.doc_id, round(r.score, 4)) for r in M.score(docs(rows).repartition(k)).collect()) for k in (1, 7))
    # the learned weights are an average over tasks; the counts are not
    assert np.allclose([s for _, s in one], [s for _, s in many], rtol=.05)


def seen_table(counts):
    """What ``Seen`` reads, from {context: {class: times}}."""
    return pa.table({"context": pa.array(list(counts), pa.int64()),
                     "seen": pa.array([[256 * n + c for c, n in x.items()] for x in counts.values()], pa.list_(pa.int64()))})


def test_bits_of_all_classes_sum_to_one():
    """Over every class that may come next the model's probabilities sum to 1."""
    rng = np.random.default_rng(1)
    known = M.Seen(seen_table({5: {int(c): int(n) for c, n in zip(rng.permutation(256)[:40], rng.integers(1, 30, 40))}, 9: {200: 3, 17: 1}}))
    mixer = M.Mixer(M.tree_counts(rng.integers(0, 500, 256).astype(float)),
                    M.neutral() + rng.normal(0, .2, M.neutral().shape).astype(np.float32))
    for match in (-1, 200):
        for one, two in ((5, 9), (5, 77), (88, 77)):
            cls = np.arange(256, dtype=np.int32)
            after = tuple(known.logits(np.full(256, c, np.uint64), cls, np.zeros(256, bool), False) for c in (one, two))
            logs, _ = mixer.run(cls, np.full(256, match, np.int32), np.arange(257), after)
            assert np.sum(10 ** logs) == pytest.approx(1, abs=1e-3)


def test_a_token_s_score_uses_only_what_came_before():
    rng = np.random.default_rng(2)
    classes = M.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    words = [b"w%d" % i for i in rng.integers(0, 60, 700)]
    keys, _, cls, one, two, _ = M._prepared(pa.array([b" ".join(words)], pa.binary()), classes)
    counts = {}
    for context, c in zip([*one.tolist(), *two.tolist()], [*cls.tolist(), *cls.tolist()]):
        counts.setdefault(int(np.uint64(context).view(np.int64)), Counter())[c] += int(rng.integers(1, 9))
    known, tree = M.Seen(seen_table(counts)), M.tree_counts(np.bincount(cls, minlength=256).astype(float))

    def prefix(n, tail=()):
        column = pa.array([b" ".join([*words[:n], *tail])], pa.binary())
        keys, first, cls, one, two, match = M._prepared(column, classes)
        first = np.array([0, n])  # without the end token
        after = tuple(known.logits(c[:n], cls[:n], np.zeros(n, bool), False) for c in (one, two))
        return M.Mixer(tree, M.neutral()).run(cls[:n], match[:n], first, after)[0][0]

    assert prefix(600) == prefix(600, [b"other", b"w1", b"w2"])
    steps = np.diff([prefix(n) for n in (500, 501, 502, 600)])
    assert (steps < 0).all()


def written_out(rows, weights):
    """The model token by token: {id: log10 probability of the text}."""
    def key_of(token):
        return int(M.token_keys(pa.array([(token or "").encode()], pa.binary()))[0][0]) if token is not None else int(M.END)

    counts = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    keys = {t: key_of(t) for _, x in rows for t in tokens(x)}
    ranked = sorted(counts, key=lambda t: (-counts[t], keys[t]))[:M.OWN]
    cls = {t: ranked.index(t) if t in ranked else M.OWN + keys[t] % M.HASHED for t in keys}
    in_class, kinds, context = Counter(), Counter(), {}
    for t, n in counts.items():
        in_class[cls[t]] += n
        kinds[cls[t]] += 1
    for i, x in rows:
        if not out(i):
            text = ["<", "<", *tokens(x)]
            for j in range(2, len(text)):
                for before in ((text[j - 1],), (text[j - 2], text[j - 1])):
                    context.setdefault(before, Counter())[cls[text[j]]] += 1

    def odds(seen, c, level):
        """Log-odds of bit 1 after the leading bits of class c, from {class: times}."""
        same = [(x, n) for x, n in seen.items() if x >> (8 - level) == c >> (8 - level)]
        one, zero = (sum(n for x, n in same if x >> (7 - level) & 1 == bit) for bit in (1, 0))
        return math.log(one + .4) - math.log(zero + .4)

    scores = {}
    for i, x in rows:
        w, total, last = weights.astype(float).copy(), 0.0, {}
        text = tokens(x)
        for at in range(0, len(text), M.BLOCK_TOKENS):
            change, times = np.zeros_like(w), np.zeros(w.shape[:2])
            for j in range(at, min(at + M.BLOCK_TOKENS, len(text))):
                t, c = text[j], cls[text[j]]
                one = text[j - 1] if j else "<"
                two = (text[j - 2] if j > 1 else "<", one)
                match = last.get(two, -1)
                last[two] = c
                for level in range(8):
                    bit = c >> (7 - level) & 1
                    gate, guess = 0, 0.0
                    if match >= 0:
                        gate = 1 if match >> (8 - level) == c >> (8 - level) else 2
                        guess = (1 if match >> (7 - level) & 1 else -1) * M.MATCH_LOGIT if gate == 1 else 0.0
                    inputs = [odds(in_class, c, level), odds(context.get((one,), {}), c, level), odds(context.get(two, {}), c, level), guess]
                    z = sum(a * b for a, b in zip(w[level, gate], inputs))
                    p = 1 / (1 + math.exp(-max(-10, min(10, z))))
                    total += math.log10(p if bit else 1 - p)
                    times[level, gate] += 1
                    for k in range(3 + (match >= 0)):
                        change[level, gate, k] += (bit - p) * inputs[k]
                own = c < M.OWN and t in ranked
                total += math.log10(counts[t] + .5) - (math.log10(counts[t] + .5) if own else math.log10(in_class[c] + .5 * (kinds[c] + 1)))
            w += M.RATE * change / (times[..., None] + 8)
        scores[i] = total
    return scores


def test_scores_match_the_model_written_out(docs, monkeypatch):
    """The whole query but the learning of the starting weights, which are given."""
    rng = np.random.default_rng(4)
    weights = M.neutral() + rng.normal(0, .1, M.neutral().shape).astype(np.float32)
    monkeypatch.setattr(M, "learned_weights", lambda *_: weights)
    rows = [(i, t) for i, t in corpus(30, seed=6)[:30]] + [(30, None), (31, ""), (32, "one two one two one two three"),
                                                           (33, " ".join(f"w{i % 23}" for i in range(700)))]
    got = {r.doc_id: r.score for r in M.score(docs(rows).repartition(3)).collect()}
    for i, want in written_out(rows, weights).items():
        assert got[i] == pytest.approx(want, rel=2e-4, abs=1e-3), i


def test_matches_point_to_the_last_follower():
    cls = np.array([5, 6, 7, 5, 6, 9, 5, 6, 1], np.int32)
    keys = cls.astype(np.uint64) * np.uint64(77)
    first = np.array([0, 9])
    _, two = M.contexts(keys, first)
    assert M.matches(cls, two, first).tolist() == [-1] * 5 + [7, -1, -1, 9]


def test_own_classes_are_found():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 128, np.uint64) & np.uint64(0xFF0000FFFFFFFFFF))  # leading bits collide
    classes = M.Classes(keys, np.arange(len(keys), dtype=np.int32))
    assert len(classes.layers) > 1 and (classes.of(keys) == np.arange(len(keys))).all()
    assert (classes.of(keys + np.uint64(1)) >= M.OWN).all()


def test_empty_and_repeated(docs):
    assert M.score(docs([])).collect() == []
    rows = M.score(docs([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert len(rows) == 3 and {r.n_tokens for r in rows} == {3, 1}
    held = next(i for i in range(50) if out(i))
    only = M.score(docs([(held, "never trained")])).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.held_out


def test_context_counts_are_exact_and_grow_with_the_contexts(docs):
    """Every different context keeps its own counts, in whatever chunk it is needed."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 5000)) for i in range(90)]
    train = [t for i, t in rows if not out(i)]
    none = M.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    want = {}
    for t in train:
        keys, first, cls, one, two, _ = M._prepared(pa.array([t.encode()], pa.binary()), none)
        for context in (one, two):
            for k, c in zip(context.tolist(), cls.tolist()):
                want.setdefault(k, Counter())[c] += 1
    df = docs(rows).repartition(3).select("doc_id", M.held_out("doc_id", 5).alias("held_out"), M.text_bytes().alias("text"))
    seen = M.context_counts(df.filter("NOT held_out").select("text"), none)
    got = {r.context % 2**64: {x & 255: x >> 8 for x in r.seen} for r in seen.collect()}
    assert got == want and len(got) > 10_000

    chunks = M.stored(M.chunked(df, 2000), "test-chunks")
    assert chunks.select("chunk").distinct().count() > 20
    rows = M.context_needs(chunks).join(seen, "context").filter("held_out OR total > 1").select("chunk", "context", "seen")

    def run(texts, known):
        for batch in M.steps(texts.to_batches()):
            keys, first, cls, one, two, _ = M._prepared(batch.column(4), none)
            ours = np.repeat(~batch.column(3).to_numpy(zero_copy_only=False), np.diff(first))
            for context in (one, two):
                n = known.passed(context, cls, ours)
                yield M.batch_of(pa.schema([("context", pa.int64()), ("cls", pa.int32()), ("n", pa.list_(pa.int64()))]),
                                 context.view(np.int64), cls, pa.array(list(n.T)))

    found = M.beside(chunks, rows, run, "context bigint, cls int, n array<bigint>").collect()
    assert len(found) == 2 * 90 * 301
    for r in found:
        after = want.get(r.context % 2**64, {})
        for level, n in enumerate(r.n):
            assert n == sum(v for c, v in after.items() if c >> (8 - level) == r.cls >> (8 - level))


def test_packed_contexts_give_what_the_join_gives_in_one_shuffle(docs, monkeypatch):
    """One shuffle of packed contexts, not rows of every context to count and again to look up."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 200) % 900)) for i in range(60)] + [(60, None), (61, "")]
    df = docs(rows).repartition(3).select("doc_id", M.held_out("doc_id", 5).alias("held_out"), M.text_bytes().alias("text"))
    classes = M.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    chunks = M.stored(M.chunked(df, 3000), "test-chunks")
    counts = M.context_counts(df.filter("NOT held_out").select("text"), classes)
    joined = M.context_needs(chunks).join(counts, "context").filter("held_out OR total > 1")
    want = {(r.chunk, r.context): sorted(r.seen) for r in joined.collect()}
    found = M.seen_by_chunk(chunks, classes).collect()
    got = {(r.chunk, r.context): sorted(r.seen) for r in found}
    assert got == want and len(want) > 3000
    monkeypatch.setattr(M, "_HELD_TOGETHER", 500)  # a chunk in several pieces
    again = {(r.chunk, r.context): sorted(r.seen) for r in M.seen_by_chunk(chunks, classes).collect()}
    assert again == want
    assert M.seen_by_chunk(chunks.filter("held_out"), classes).collect() == []
    plan = M.seen_by_chunk(chunks, classes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_what_the_scorer_stores_stays_small_beside_the_texts(docs, spark, monkeypatch):
    """Texts, cells and answers are packed; no row for each context, and no shuffle is left from a step done before."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'word' * 3}{int(x)}" for x in rng.zipf(1.3, 3000) % 4000)) for i in range(250)]
    df = M.stored(docs(rows).repartition(4), "test-texts")
    tables = {}

    def kept(table, name, put=M.stored):
        tables[name] = put(table, name)
        return tables[name]

    monkeypatch.setattr(M, "stored", kept)
    M.score(df).write.format("noop").mode("overwrite").save()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def size(table):
        paths = [fs.Path(f) for f in table.inputFiles()]
        return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)

    tokens = sum(len(t.split()) + 1 for _, t in rows)
    assert sum(size(t) for t in tables.values()) < 9 * tokens
    assert all(t.count() < tokens / 100 for name, t in tables.items() if name != "lm-words")


def test_cells_tell_what_the_join_tells(docs, spark, monkeypatch):
    """The log-odds from packed answers are those of the whole table of contexts, whatever
    the parts, for words of the head and others and for counts above a byte."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 400) % 900)) for i in range(80)] + [(80, None), (81, "")]
    df = docs(rows).repartition(3).select("doc_id", M.held_out("doc_id", 5).alias("held_out"), M.text_bytes().alias("text"))
    chunks = M.stored(M.coded(df, 4000), "test-chunks")
    assert chunks.count() > 15
    counts = M.word_counts(chunks)
    for bits, head in ((2, 1 << 20), (6, 300)):
        vocab = M.vocabulary(counts, head)
        seen = M.context_counts(df.filter("NOT held_out").select("text"), vocab.classes).toArrow()
        known = M.Seen(seen)
        assert known.upto[-1] == 2 * vocab.tokens
        answers = M.cell_counts(chunks, spark.sparkContext.broadcast(vocab), bits).toArrow()
        texts = dict((i, t) for i, t in rows)
        told, large = list(M._rows(answers)), 0
        for row in M._rows(chunks.drop("n").toArrow()):
            chunk = M.Chunk(row, vocab, bits)
            mine = [a for a in told if a["chunk"] == row["chunk"]]
            column = pa.array([(texts[i] or "").encode() for i in row["doc_id"].to_pylist()], pa.binary())
            keys, first, cls, *after, _ = M._prepared(column, vocab.classes)
            assert (cls == chunk.cls).all() and (first == chunk.first).all()
            ours = np.repeat(~chunk.held_out, np.diff(first))
            for leave_one_out, asked in ((False, ours | True), (True, ours)):
                odds = chunk.logits(mine, leave_one_out)
                for context, cell in zip(after, chunk.cell):
                    want = known.logits(context[asked], cls[asked], np.zeros(asked.sum(), bool), leave_one_out)
                    assert np.allclose(odds[cell[asked]], want, atol=1e-5)
            large += sum(a["size"] > 9 * a["cells"] for a in mine)
        assert large > 15
