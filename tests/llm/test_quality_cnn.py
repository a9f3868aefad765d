"""The network's gradients and coverage; held-out accuracy."""

import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.llm import quality_cnn as C
from claimspark.llm.common import buffers


def column(texts):
    return pa.array(texts, pa.binary())


def test_chunks_cover_every_window_of_the_text():
    for n in (0, 1, 7, C.WIDTH, C.CHUNK - 1, C.CHUNK, C.CHUNK + 1, 3 * C.CHUNK + 5):
        data = np.arange(n) % 251
        parts, first = C.chunks(*buffers(column([b"zz", data.astype(np.uint8).tobytes()])))
        own = parts[first[1]:first[2]]
        seen = {tuple(c[i:i + C.WIDTH]) for c in own for i in range(0, C.CHUNK - C.WIDTH + 1, C.STRIDE)}
        full = np.append(data, np.full(C.CHUNK, C.PAD))
        want = {tuple(full[i:i + C.WIDTH]) for i in range(0, max(n, 1), C.STRIDE)}
        assert want <= seen | {tuple(full[i:i + C.WIDTH]) for i in range(max(0, n - C.STRIDE), n)}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (30, 700, 1200)]
    parts, first = C.chunks(*buffers(column(texts)))
    label = np.array([1, 0, 1], np.float32)
    net = C.Network.fresh()
    net.out[:] = rng.normal(0, .5, len(net.out))
    grads = C._gradients(net, parts, first, label)

    def loss():
        p = C.predict(net, column(texts))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for part, grad in zip(net.parts(), grads):
        flat, g = part.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            kept, step = flat[i], np.float32(1e-2)
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(g[i], rel=.15, abs=2e-4)


def test_position_and_slicing_do_not_matter():
    rng = np.random.default_rng(1)
    net = C.Network.fresh()
    net.out[:] = rng.normal(0, .3, len(net.out))
    texts = [bytes(rng.integers(0, 256, int(n), np.uint8)) for n in rng.integers(0, 3000, 30)]
    whole = C.predict(net, column(texts), block=7)
    assert np.allclose(whole, [C.predict(net, column([t]))[0] for t in texts], atol=1e-5)


def naive_score(net, text):
    """The network written out text by text: every window of the padded text."""
    data = [*text]
    best, sums, n_chunks, at = [0.0] * C.FILTERS, [0.0] * C.FILTERS, 0, 0
    while at == 0 or at + (C.WIDTH - C.STRIDE) < len(data):
        chunk = (data[at:at + C.CHUNK] + [C.PAD] * C.CHUNK)[:C.CHUNK]
        tops = [0.0] * C.FILTERS
        for i in range(0, C.CHUNK - C.WIDTH + 1, C.STRIDE):
            x = np.concatenate([net.embed[b] for b in chunk[i:i + C.WIDTH]])
            tops = np.maximum(tops, x @ net.filters + net.bias)
        best, sums, n_chunks, at = np.maximum(best, tops), np.add(sums, tops), n_chunks + 1, at + C.CHUNK - (C.WIDTH - C.STRIDE)
    return 1 / (1 + math.exp(-(best @ net.out[:C.FILTERS] + (sums / n_chunks) @ net.out[C.FILTERS:-1] + net.out[-1])))


def test_scores_match_the_network_written_out():
    rng = np.random.default_rng(6)
    net = C.Network.fresh()
    net.bias[:], net.out[:] = rng.normal(0, .2, C.FILTERS), rng.normal(0, .3, len(net.out))
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 9, 500, C.CHUNK, 1300, 2600)]
    assert np.allclose(C.predict(net, column(texts)), [naive_score(net, t) for t in texts], atol=1e-5)


def test_gradients_do_not_depend_on_the_block():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (40, 9000, 2500, 20_000)]
    parts, first = C.chunks(*buffers(column(texts)))
    net = C.Network.fresh()
    net.out[:] = rng.normal(0, .5, len(net.out))
    label = np.array([1, 0, 1, 0], np.float32)
    for a, b in zip(C._gradients(net, parts, first, label, 7), C._gradients(net, parts, first, label, 10_000)):
        assert np.allclose(a, b, atol=1e-5)


def test_a_long_text_is_scored_in_little_memory():
    net = C.Network.fresh()
    text = np.random.default_rng(2).integers(32, 127, 20_000_000, np.uint8).tobytes()
    tracemalloc.start()
    C.predict(net, column([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)


def labelled(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        text, good = list(rng.choice(words, int(rng.integers(20, 200)))), i % 3 > 0
        if not good:
            at = int(rng.integers(len(text)))
            text[at:] = [w + "###" for w in text[at:]]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_blindness_to_other_columns(spark, docs):
    rows, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in C.score(docs(rows), table).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r.held_out} == held
    assert np.mean([got[i].predicted == q for i, q, _ in labels if i in held]) > .95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got.values())
    # labels of held-out rows and the other columns change nothing
    turned = spark.createDataFrame([(i, 1 - q if i in held else q, 1) for i, q, _ in labels], table.schema)
    other = docs([(i, t, "xx", "other") for i, t in rows]).withColumn("label", F.lit("x")).withColumn("score", F.lit("x"))
    again = {r.doc_id: r.score for r in C.score(other, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_defined_cases(spark, docs):
    rows, labels = labelled(60)
    extra = [(1000, None), (1001, ""), (None, "abc"), (3, "again"), (1002, "x" * 300_000)]
    marks = [*labels, (5, None, None), (None, 1, 0), (7, 0, 0), (9999, 1, 1)]
    table = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = C.score(docs(rows + extra), table, max_train_rows=20).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert C.score(docs([]), table).collect() == []
    none = table.limit(0)
    assert {r.score for r in C.score(docs(rows), none).collect()} == {.5}
    ones = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], table.schema)
    assert {r.predicted for r in C.score(docs(rows), ones).collect()} == {1}


def test_the_sample_is_bounded(spark, docs):
    rows, labels = labelled(200)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    known = C.known_labels(table, 3, 1)
    sample = C.training_rows(docs(rows + rows), known, 30).collect()
    assert len(sample) == 30 and sum(r.label for r in sample) == 15
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in sample)
