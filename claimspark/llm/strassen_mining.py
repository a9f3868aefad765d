"""Hard-negative mining by Strassen products of int64 tiles.

Every vector is a list of integers floor(scale * x); a row's score is its inner
product with an anchor.  Scores of a tile of anchors and a tile of candidates
are one matrix product, computed by Strassen's recursion: odd sides are padded
with zeros, seven products of halves replace eight, and blocks of at most
``LEAF`` on a side are multiplied directly.  All additions are of integers, so the
scores are exact; sums that leave 64 bits on the way wrap and come back.

1. Positives.  A task keeps the ``positives`` best other rows of the anchor's
   label, a heap an anchor that is merged tile by tile; Spark merges the tasks'
   heaps.
2. Windows.  Each anchor and positive has an interval of negative scores,
   low * positive <= 100 * negative <= high * positive.  A task keeps the
   ``negatives`` best rows of other labels inside each interval, again in heaps
   that are merged tile by tile and then between tasks.

Scale: the vectors are scanned twice for a block of anchors and never
shuffled; the anchors, a stated set, are broadcast in blocks of about
``block_bytes``, their positives (at most ``positives`` an anchor) with them.  A
task holds a heap of ``positives * negatives`` entries an anchor of the block and
shuffles no more than that; no label, however frequent, is gathered anywhere.

Defined cases: rows with a null id, a null label, a null vector or any null or
non-finite component take no part.  A vector with fewer components than another
counts as zero there.  An id that several rows carry is one anchor, by its row
with the least label and then vector; as candidates such rows count each,
but never for an anchor of their own id.  Ties go to smaller ids.  Components of
any size are exact (those over 2^``LIMB`` are multiplied limb by limb); a score
outside a long counts as the end of its range there.  Anchors without positives,
and positives without negatives in their interval, give no rows; an empty table
gives an empty result.  Only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import batch_of, drained, stored, workers_find_package

#: Side of the blocks that are multiplied directly.
LEAF = 32
#: Anchors and candidates of a tile.
ANCHORS, CANDIDATES = 512, 2048
#: Bits of a limb of a large component.
LIMB = 24
_MOST = (1 << 63) - 1
_NONE = np.int64(-_MOST - 1)  # below every score


# --- products ------------------------------------------------------------------------

def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices (exact wherever it fits into 64 bits)."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m] = p1 + p4 - p5 + p7
    out[:n, m:] = p3 + p5
    out[n:, :m] = p2 + p4
    out[n:, m:] = p1 - p2 + p3 + p6
    return out


def limbs(x: np.ndarray, scale: int) -> list[np.ndarray]:
    """int64 matrices, least first, whose sum times 2^(LIMB * place) is
    floor(scale * x); one matrix if no component is large."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    if not np.isfinite(whole).all():  # the product leaves a double: by long integers
        left = np.array([math.floor(c) * scale if abs(c) > 1e200 else math.floor(c * scale) for c in x.ravel().tolist()],
                        object).reshape(x.shape)
        out = []
        while (np.abs(left) > 1 << LIMB).any():
            out.append((left & ((1 << LIMB) - 1)).astype(np.int64))
            left = left >> LIMB
        return [*out, left.astype(np.int64)]
    out = []
    while len(whole) and whole.size and np.abs(whole).max() > 1 << LIMB:
        upper = np.floor(whole * 2.0 ** -LIMB)  # exact: a shift by a power of two
        out.append((whole - upper * 2.0 ** LIMB).astype(np.int64))
        whole = upper
    return [*out, whole.astype(np.int64)]


def scores(anchors: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """(anchors, candidates) inner products as longs, held within their range."""
    if len(anchors) == len(candidates) == 1:
        if anchors[0].shape[1] <= 1 << (62 - 2 * LIMB):
            return strassen(anchors[0], candidates[0].T)
    total: np.ndarray | int = 0
    wide = 1 << (62 - 2 * LIMB)  # dimensions whose products of limbs fit into 64 bits
    for i, a in enumerate(anchors):
        for j, b in enumerate(candidates):
            for d in range(0, max(1, a.shape[1]), wide):
                total = total + (strassen(a[:, d:d + wide], b[:, d:d + wide].T).astype(object) << (LIMB * (i + j)))
    return np.minimum(np.maximum(total, -_MOST), _MOST).astype(np.int64)


# --- heaps ------------------------------------------------------------------------------

class Heaps:
    """The best ``size`` (score, id) of each of ``n`` lists, merged block by block."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), _NONE)
        self.id = np.zeros((n, size), np.int64)

    def add(self, first: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer a block: row i of ``score`` belongs to list ``first`` + i, ``_NONE`` is no entry."""
        n = len(score)
        least = self.score[first:first + n, -1]  # the worst entry of a full list
        if score.shape[1] > self.size:
            best = np.partition(score, score.shape[1] - self.size, axis=1)[:, score.shape[1] - self.size]
            least = np.maximum(least, best)
        row, at = np.nonzero((score >= least[:, None]) & (score > _NONE))
        if not len(row):
            return
        held_row, held_at = np.nonzero(self.score[first:first + n] > _NONE)
        touched = np.zeros(n, bool)
        touched[row] = True
        held = touched[held_row]
        held_row, held_at = held_row[held], held_at[held]
        rows = np.concatenate([held_row, row])
        value = np.concatenate([self.score[first + held_row, held_at], score[row, at]])
        found = np.concatenate([self.id[first + held_row, held_at], ids[at]])
        order = np.lexsort((found, ~value, rows))  # ~value falls as the score rises, without overflow
        rows, value, found = rows[order], value[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.size
        self.score[first + rows[keep], place[keep]] = value[keep]
        self.id[first + rows[keep], place[keep]] = found[keep]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, id, score) of everything held."""
        row, at = np.nonzero(self.score > _NONE)
        return row, self.id[row, at], self.score[row, at]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest n with low * positive <= 100 * n <= high * positive, within a long."""
    return max(-(-low * positive // 100), -_MOST), min(high * positive // 100, _MOST)


# --- jobs ---------------------------------------------------------------------------------

def usable(vectors: DataFrame, relabel_every: int, labels: int, id_column: str, vector_column: str,
           label_column: str) -> DataFrame:
    """(id, label, v): the rows that take part, with the labels moved on where the
    id is divisible by ``relabel_every``."""
    row_id, label = F.col(f"`{id_column}`").cast("bigint"), F.col(f"`{label_column}`").cast("bigint")
    x = F.col(f"`{vector_column}`").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    if relabel_every:
        label = F.when(row_id % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return vectors.select(row_id.alias("id"), label.alias("label"), x.alias("v"), fine.alias("ok")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND ok").select("id", "label", "v")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles, short rows filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, relabel_every: int = 0, labels: int = 10, id_column: str = "vec_id",
         vector_column: str = "embedding", label_column: str = "label", block_bytes: int = 32 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and
    positive_rank, for the anchors, the rows whose id is divisible by ``every``."""
    workers_find_package(vectors.sparkSession)
    rows = stored(usable(vectors, relabel_every, labels, id_column, vector_column, label_column), "mining-vectors")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.*")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    held = 8 * (dims + 2 * positives * (negatives + 1))  # of an anchor: its vector and its heaps
    blocks = max(1, -(-asked.count() * held // block_bytes))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "mining-anchors")
    out = None
    for b in range(blocks):
        part = _block(rows, asked.filter(F.col("block") == b), dims, positives, negatives, low, high, scale)
        out = part if out is None else out.unionByName(part)
    return out


def _block(rows: DataFrame, asked: DataFrame, dims: int, positives: int, negatives: int, low: int, high: int,
           scale: int) -> DataFrame:
    spark = rows.sparkSession
    table = asked.select("id", "label", "v").orderBy("id").toArrow().combine_chunks()  # at most about block_bytes
    batch = table.to_batches()
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    shared = spark.sparkContext.broadcast((ids, labels, _matrix(batch[0].column(2), dims) if batch else np.zeros((0, dims))))

    def tiles(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first anchor, scores, ids) of every tile; no score where the label is not wanted."""
        ids, labels, v = shared.value
        anchors = [(i, limbs(v[i:i + ANCHORS], scale)) for i in range(0, len(ids), ANCHORS)]
        for batch in drained(batches):
            for i in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(i, CANDIDATES)
                found, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                theirs = limbs(_matrix(part.column(2), dims), scale)
                for first, ours in anchors:
                    its = slice(first, first + ANCHORS)
                    wanted = (labels[its, None] == label) == same
                    wanted &= ids[its, None] != found
                    yield first, np.where(wanted, scores(ours, theirs), _NONE), found

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(shared.value[0]), positives)
        for first, score, found in tiles(batches, same=True):
            heaps.add(first, score, found)
        yield batch_of(pa.schema([("a", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]), *heaps.entries())

    best = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    merged = (rows.mapInArrow(nearest, "a bigint, id bigint, score bigint").withColumn("r", F.row_number().over(best))
              .filter(F.col("r") <= positives).toArrow())  # a few rows an anchor of the block
    a, positive, score, r = (merged.column(c).to_numpy() for c in ("a", "id", "score", "r"))
    bounds = np.zeros((2, positives, len(ids)), np.int64)
    bounds[0], bounds[1] = _MOST, -_MOST  # nothing lies between
    for i, s, at in zip(a.tolist(), score.tolist(), r.tolist()):
        bounds[:, at - 1, i] = window(s, low, high)
    names = np.zeros((2, positives, len(ids)), np.int64)
    names[:, r - 1, a] = positive, score
    windows = spark.sparkContext.broadcast(bounds)
    known = spark.sparkContext.broadcast(names)
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score",
                                                   "negative_score", "positive_rank")])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = windows.value
        heaps = [Heaps(len(shared.value[0]), negatives) for _ in range(positives)]
        for first, score, found in tiles(batches, same=False):
            its = slice(first, first + len(score))
            for heap, least, most in zip(heaps, lo[:, its, None], hi[:, its, None]):
                if (least <= most).any():
                    heap.add(first, np.where((score >= least) & (score <= most), score, _NONE), found)
        name, theirs = known.value
        for place, heap in enumerate(heaps):
            at, found, score = heap.entries()
            yield batch_of(schema, shared.value[0][at], name[place, at], found, theirs[place, at], score,
                           np.full(len(at), place + 1))

    best = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    return (rows.mapInArrow(inside, ", ".join(f"{f.name} bigint" for f in schema))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"))


def oracle(every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
           relabel_every: int = 7, labels: int = 10) -> str:
    """DuckDB SQL for ``mine`` (vectors of equal length, unique ids)."""
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {relabel_every} = 0 THEN (label + 1) % {labels} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON c.vec_id <> a.vec_id WHERE a.vec_id % {every} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE positive_rank <= {positives} AND NOT same
    AND {low} * positive_score <= 100 * s.score AND 100 * s.score <= {high} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= {negatives}"""
