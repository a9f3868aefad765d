"""Language identification by hierarchical discrimination.

A text is predicted in two steps.  First its language family, by one-versus-one
linear support vector machines between families; then its language, by
one-versus-one machines between the languages of that family alone, so the
second step has only close relatives to tell apart.  The machines of a step vote
with their margins; the score is the product of both steps' shares.

Features: the lower-cased UTF-8 bytes of the whole text, other ASCII than
letters as one space; sequences of one to four bytes that hold no two spaces in a
row are hashed to 2^``BITS`` cells.  A cell counts 1 + log(times), the vector has
length one.

Training: the feature vectors of at most ``max_train_rows`` texts, as many of each
language, those with the smallest hash of id and text, are fitted on the driver
by dual coordinate descent (squared hinge loss); a vector has at most 2^``BITS``
entries however long its text is.  That sample is the only bounded part.
Families come from ``FAMILIES``; a language that is not in it is a family of its own.

Scale: one aggregate over the languages, one pass that makes the sample's vectors
and one that scores every text whole, with the few weight vectors broadcast; no
text is shuffled.  A very long text is read piece by piece into one count vector.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
nothing is learned from it; neither is anything from rows with a null language.
A null id counts as '' in the split.  With one learned language every other text
has that and score 1, without any ``und`` and 0.  Equal votes go to the name that
sorts first.  Repeated rows are predicted each and learned from once; an empty
table gives an empty result.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import STEP_BYTES, batch_of, buffers, held_out, steps, stored, workers_find_package

BITS = 15
ORDERS = 4
#: Bytes of a very long text that are counted at a time, and rows of a step.
PIECE, ROWS = 1 << 20, 1 << 16
UNDECIDED = "und"

# FIXED VALUES: languages (ISO 639-1) by family
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo",
    "romance": "fr es it pt ca gl oc ro",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}

_LETTER = np.full(256, ord(" "), np.uint8)
_LETTER[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


# --- features -------------------------------------------------------------------------

def prepared(column: str = "text") -> Column:
    """The lower-cased text between two spaces as UTF-8 bytes, null as empty."""
    text = F.lower(F.col(f"`{column}`"))
    return F.coalesce(F.concat(F.lit(" "), text, F.lit(" ")).cast("binary"), F.lit(b""))


def has_letter(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").rlike(r"\p{L}"), F.lit(False))


def cells(data: np.ndarray, left: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, cell) of the byte sequences of each length that start before ``upto``;
    ``left`` is how many bytes each byte's text has from there on."""
    data = _LETTER[data]
    space = data == ord(" ")
    fine = ~space[:upto]
    code = data[:upto].astype(np.uint32)
    for order in range(1, ORDERS + 1):
        if order == 2:
            fine = np.ones(upto, bool)
        if order > 1:
            n = min(upto, max(0, len(data) - order + 1))
            fine, code = fine[:n], code[:n]
            fine = fine & (left[:n] >= order) & ~(space[order - 2:order - 2 + n] & space[order - 1:order - 1 + n])
            code = code | (data[order - 1:order - 1 + n].astype(np.uint32) << np.uint32(8 * (order - 1)))
        start = np.flatnonzero(fine)
        mixed = (code[start] ^ np.uint32(order * 0x01000193 & 0xFFFFFFFF)) * np.uint32(2654435761)
        yield start, mixed >> np.uint32(32 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, value) of the texts' vectors, by row and cell."""
    n = len(offsets) - 1
    if n == 1 and len(data) > 2 * PIECE:
        total = np.zeros(1 << BITS, np.int64)
        for a in range(0, len(data), PIECE):
            part = data[a:a + PIECE + ORDERS - 1]
            left = np.arange(len(data) - a, len(data) - a - len(part), -1)
            for _, cell in cells(part, left, min(PIECE, len(part))):
                total += np.bincount(cell, minlength=1 << BITS)
        cell = np.flatnonzero(total)
        row, count = np.zeros(len(cell), np.int64), total[cell]
    else:
        row_of = np.repeat(np.arange(n, dtype=np.uint32), np.diff(offsets))
        left = offsets[1:][row_of] - np.arange(len(data))
        keys = [(row_of[start] << np.uint32(BITS)) | cell for start, cell in cells(data, left, len(data))]
        key = np.sort(np.concatenate(keys))
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[:len(key)]
        count = np.diff(np.append(edge, len(key)))
        key = key[edge].astype(np.int64)
        row, cell = key >> BITS, key & ((1 << BITS) - 1)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    return row, cell, value / norm[row]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, limit=STEP_BYTES):
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


# --- machines -------------------------------------------------------------------------

def fit_machine(vectors: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 1.0, epochs: int = 15,
                seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with
    squared hinge loss, by dual coordinate descent; both classes weigh the same."""
    w = np.zeros((1 << BITS) + 1)
    alpha = np.zeros(len(sign))
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    diagonal = share / cost  # 1 / (2 C), C = cost / (2 share)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(sign)):
            cell, value = vectors[i]
            gradient = sign[i] * (w[cell] @ value + w[-1]) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / (value @ value + 1 + diagonal[i]), 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[cell] += step * value
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class Votes:
    """One-versus-one machines between the names."""

    names: list[str]
    weights: np.ndarray  # (pairs, cells + 1)

    @classmethod
    def fit(cls, names: list[str], labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Votes:
        machines = []
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            machines.append(fit_machine([vectors[i] for i in rows], np.where(labels[rows] == a, 1.0, -1.0)))
        return cls(names, np.array(machines).reshape(len(machines), (1 << BITS) + 1))

    def shares(self, row: np.ndarray, cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """(n, names): the part of the votes that each name has."""
        k = len(self.names)
        out = np.ones((n, k)) if k == 1 else np.zeros((n, k))
        for (a, b), w in zip(combinations(range(k), 2), self.weights):
            margin = np.bincount(row, weights=value * w[cell], minlength=n) + w[-1]
            for_a = 1 / (1 + np.exp(np.clip(-3 * margin, -60, 60)))
            out[:, a] += for_a
            out[:, b] += 1 - for_a
        return out / max(1, k * (k - 1) // 2)


class Hierarchy:
    """Families, and the languages within each."""

    def __init__(self, labels: list[str], vectors: list[tuple[np.ndarray, np.ndarray]], families: dict[str, str]):
        family_of = {lang: family for family, languages in families.items() for lang in languages.split()}
        names = np.array(labels, object)
        kin = np.array([family_of.get(x, x) for x in labels], object)
        self.families = Votes.fit(sorted(set(kin)), kin, vectors)
        self.languages = []
        for family in self.families.names:
            rows = np.flatnonzero(kin == family)
            self.languages.append(Votes.fit(sorted(set(names[rows])), names[rows], [vectors[i] for i in rows]))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        n = len(offsets) - 1
        row, cell, value = features(data, offsets)
        share = self.families.shares(row, cell, value, n)
        family = share.argmax(axis=1)
        score = share[np.arange(n), family]
        name = np.empty(n, object)
        for f, votes in enumerate(self.languages):
            ours = np.flatnonzero(family == f)
            if not len(ours):
                continue
            place = np.full(n, -1)
            place[ours] = np.arange(len(ours))
            keep = place[row] >= 0
            inner = votes.shares(place[row[keep]], cell[keep], value[keep], len(ours))
            best = inner.argmax(axis=1)
            name[ours] = np.array(votes.names, object)[best]
            score[ours] *= inner[np.arange(len(ours)), best]
        return name, score


# --- jobs -----------------------------------------------------------------------------

def training_vectors(docs: DataFrame, modulus: int, remainder: int, max_train_rows: int) -> DataFrame:
    """(lang, turn, cell, value): the bounded sample, as many rows of each language."""
    known = (docs.filter(F.col("lang").isNotNull() & has_letter() & ~held_out("doc_id", modulus, remainder))
             .select("lang", F.xxhash64("doc_id", "text").alias("turn"), prepared().alias("text")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # one row a language
    quota = max(1, max_train_rows // max(1, len(sizes)))
    # half more than needed by hash, before the exact limit
    part = {r["lang"]: min(1.0, (1.5 * quota + 20) / r["rows"]) for r in sizes}
    limits = docs.sparkSession.createDataFrame(
        [(lang, int(-(1 << 63) + p * ((1 << 64) - 1)) if p < 1 else (1 << 63) - 1) for lang, p in part.items()],
        "lang string, below bigint")
    picked = known.join(F.broadcast(limits), "lang").filter(F.col("turn") <= F.col("below")).select("lang", "turn", "text")
    schema = pa.schema([("lang", pa.string()), ("turn", pa.int64()), ("cell", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            row, cell, value = features(*buffers(batch.column(2)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield batch_of(schema, batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(cell, pa.int32())),
                           pa.ListArray.from_arrays(ends, pa.array(value, pa.float32())))

    vectors = picked.mapInArrow(run, "lang string, turn bigint, cell array<int>, value array<float>")
    once = vectors.dropDuplicates(["lang", "turn"])  # rows of one hash are one text
    order = Window.partitionBy("lang").orderBy("turn")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota).drop("place")


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a list column as views of its values."""
    first = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(), (first - first[0])[1:-1])


def predict(docs: DataFrame, modulus: int = 4, remainder: int = 2, max_train_rows: int = 4000,
            families: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``."""
    spark = docs.sparkSession
    workers_find_package(spark)
    sample = stored(training_vectors(docs, modulus, remainder, max_train_rows), "language-sample").orderBy("lang", "turn").toArrow()
    vectors = [pair for batch in sample.to_batches() for pair in zip(_rows(batch.column(2)), _rows(batch.column(3)))]
    model = Hierarchy(sample.column("lang").to_pylist(), vectors, FAMILIES if families is None else families) if vectors else None
    del sample, vectors
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            n = batch.num_rows
            name, score = np.full(n, UNDECIDED, object), np.zeros(n)
            rows = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            if len(rows) and shared.value is not None:
                name[rows], score[rows] = shared.value.predict(*buffers(batch.column(3).take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), has_letter().alias("letters"),
                       prepared().alias("text")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
