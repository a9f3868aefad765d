"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a text are embedded and convolved with learned filters (width
``WIDTH``, stride ``STRIDE``) over overlapping chunks of ``CHUNK`` bytes that
cover all of it.  A chunk keeps the maximum of each filter; a document the
maximum and the mean of its chunks.  One logistic unit combines them into the
probability of label 1.

Training: at most ``max_train_rows`` labelled rows, half of each label, those
with the smallest hash of their id, are fitted on the driver by Adam (the only
bounded part); the bias is then set back to the odds of all labels.  Scoring: every text whole, one pass of Arrow batches with the
few thousand weights in the closure, no shuffle.  Neither labels nor lang,
source or doc_id enter a score.

Defined cases: a null or empty text is one chunk of padding.  Labels that are
null, or of ids that are null, are not learned from; ids labelled twice count
with the larger label.  Without labelled rows of both kinds every score is the
share of label 1, or 0.5.  Repeated rows are scored each; an empty table gives
an empty result.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import buffers, held_out, steps, stored, text_bytes, workers_find_package

PAD = 256
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
#: Chunks overlap by WIDTH - STRIDE bytes, so that every window lies in one.
WINDOWS = 128
CHUNK = STRIDE * (WINDOWS - 1) + WIDTH
_STEP = CHUNK - (WIDTH - STRIDE)


@dataclass
class Network:
    embed: np.ndarray  # (257, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 1,)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
                   rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out]


def first_chunks(offsets: np.ndarray) -> np.ndarray:
    """Number of each text's first chunk (length texts + 1)."""
    size = np.diff(offsets)
    return np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.maximum(size - (WIDTH - STRIDE), 0) // _STEP)))])


def chunk_block(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(hi - lo, CHUNK) byte values of chunks lo .. hi, padded with PAD."""
    number = np.arange(lo, hi)
    text = np.searchsorted(first, number, side="right") - 1
    within = (number - first[text])[:, None] * _STEP + np.arange(CHUNK)
    inside = within < (offsets[text + 1] - offsets[text])[:, None]
    out = np.full(within.shape, PAD, np.int16)
    out[inside] = data[(within + offsets[text][:, None])[inside]]
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) byte values padded with PAD, and each text's first chunk."""
    first = first_chunks(offsets)
    return chunk_block(data, offsets, first, 0, int(first[-1])), first


def _windows(net: Network, block: np.ndarray) -> np.ndarray:
    """(chunks, WINDOWS, WIDTH * EMBED) embedded windows."""
    x = np.ascontiguousarray(net.embed[block]).reshape(len(block), CHUNK * EMBED)
    return np.lib.stride_tricks.as_strided(
        x, (len(block), WINDOWS, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * 4, 4))


def chunk_maxima(net: Network, block: np.ndarray) -> np.ndarray:
    """(chunks, FILTERS) maxima of the rectified filters."""
    z = _windows(net, block).reshape(-1, WIDTH * EMBED) @ net.filters
    return np.maximum(z.reshape(len(block), WINDOWS, FILTERS).max(axis=1) + net.bias, 0)


def pooled(maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * FILTERS + 1): maximum and mean over each text's chunks, and 1."""
    count = np.diff(first)[:, None]
    return np.concatenate([np.maximum.reduceat(maxima, first[:-1], axis=0),
                           np.add.reduceat(maxima, first[:-1], axis=0) / count,
                           np.ones((len(count), 1), np.float32)], axis=1).astype(np.float32)


def predict(net: Network, column: pa.Array, block: int = 512) -> np.ndarray:
    """Probability of label 1 of each text; memory is that of ``block`` chunks."""
    if not len(column):
        return np.zeros(0)
    data, offsets = buffers(column)
    first = first_chunks(offsets)
    n = int(first[-1])
    maxima = np.concatenate([chunk_maxima(net, chunk_block(data, offsets, first, i, min(n, i + block))) for i in range(0, n, block)])
    return 1 / (1 + np.exp(-(pooled(maxima, first) @ net.out).astype(np.float64)))


# --- training -------------------------------------------------------------------------

def _gradients(net: Network, parts: np.ndarray, first: np.ndarray, label: np.ndarray, block: int = 512) -> list[np.ndarray]:
    """Mean gradients over the texts, ``block`` chunks at a time: the maxima of all
    chunks first, then what each block adds."""
    maxima = np.concatenate([chunk_maxima(net, parts[i:i + block]) for i in range(0, len(parts), block)])
    features = pooled(maxima, first)
    p = 1 / (1 + np.exp(-features @ net.out))
    err = ((p - label) / len(label)).astype(np.float32)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    is_max = maxima == features[text, :FILTERS]
    d_max = err[text, None] * (net.out[:FILTERS] * is_max + net.out[FILTERS:-1] / count[text, None])
    d_max = np.where(maxima > 0, d_max, 0).astype(np.float32)
    d_embed, d_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
    for lo in range(0, len(parts), block):
        part, d = parts[lo:lo + block], d_max[lo:lo + block]
        windows = _windows(net, part)
        z = (windows.reshape(-1, WIDTH * EMBED) @ net.filters).reshape(len(part), WINDOWS, FILTERS)
        best = z.argmax(axis=1)
        row = np.arange(len(part))
        chosen = windows[row[:, None], best]  # (chunks, FILTERS, WIDTH * EMBED)
        d_filters += np.einsum("cf,cfw->wf", d, chosen)
        d_window = (d[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
        byte = part[row[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1, WIDTH)
        np.add.at(d_embed, byte, d_window)
    return [d_embed, d_filters, d_max.sum(axis=0), features.T @ err]


def fit(texts: list[bytes], labels: np.ndarray, min_steps: int = 500, batch: int = 32, rate: float = 0.01,
        seed: int = 11) -> Network:
    """Adam over shuffled batches of whole texts, whole epochs of at least
    ``min_steps`` batches in total."""
    epochs = -(-min_steps * batch // len(texts))
    net, rng = Network.fresh(seed), np.random.Generator(np.random.PCG64(seed + 1))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parts()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            parts, first = chunks(*buffers(pa.array([texts[r] for r in rows], pa.binary())))
            step += 1
            for part, grad, (m, v) in zip(net.parts(), _gradients(net, parts, first, labels[rows]), moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def known_labels(labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label) that may be learned from."""
    return (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
            .filter(~held_out("doc_id", modulus, remainder)))


def training_rows(docs: DataFrame, known: DataFrame, max_train_rows: int) -> DataFrame:
    """(doc_id, label, text): the bounded sample, half of each label if there are so many."""
    known = known.withColumn("turn", F.xxhash64("doc_id"))
    half = max(1, max_train_rows // 2)
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("turn", "doc_id").limit(half)
        sample = part if sample is None else sample.unionByName(part)
    sample = stored(sample, "cnn-sample")
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_train_rows
    return texts.groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text")).orderBy("turn", "doc_id")


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1,
          max_train_rows: int = 2400) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    workers_find_package(docs.sparkSession)
    known = known_labels(labels, modulus, remainder)
    rows = training_rows(docs, known, max_train_rows).select("label", "text").toArrow()
    truth = rows.column("label").to_numpy().astype(np.float32)
    net = Network.fresh()
    if 0 < truth.sum() < len(truth):
        net = fit(rows.column("text").to_pylist(), truth)
        total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
        # the sample is balanced, the labels are not: back to their odds
        net.out[-1] += np.log(total[1] / total[0]) - np.log(truth.sum() / (1 - truth).sum())
    elif len(truth):
        net.out[-1] = 12.0 if truth[0] else -12.0
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            p = predict(net, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
