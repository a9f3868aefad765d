"""Exact top-k inner products by the three-phase uniform threshold (TPUT).

Every vector is a list of integers floor(scale * x); the score of a query and
a vector is the sum of ``LISTS`` partial scores, one per slice of the
dimensions (Cao and Wang, PODC 2004).

1. Each task takes the best of every local list, resolves these few vectors
   fully and gives its best totals (with many tasks a few each suffice, with
   one task k).  The k-th best of all totals is a safe cutoff: k vectors reach it.
2. The cutoff goes back to all tasks.  A total that reaches it has at least one
   partial score of cutoff / LISTS or more, so only such entries are collected.
3. The collected entries are resolved exactly; what reaches the cutoff and is
   among its task's k best (ties: smaller id) is merged into the result.

Scale: the vectors are scanned, never shuffled; the queries, a stated set, are
broadcast with their cutoffs in blocks of about ``block_bytes`` whatever their
number, and the work is split over all tasks.  Phase 1 shuffles about 4 k totals
a query, or one a task; phase 3 little more than the result.

Defined cases: null vectors and vectors with null or non-finite components take
no part.  A vector with fewer components than another counts as zero there.  A
candidate is every row whose id is not the query's.  Rows that repeat an id are
candidates each; as a query the least of their vectors counts.  A null id is no
query and no candidate.  With fewer candidates than k all are returned; an
empty table gives an empty result.  Only the two named columns are read.
Finite components of any size take part: scores that no machine number holds are
added up from limbs, exactly; one outside a long counts as the end of its range
there (components beyond 1e308 / scale count as that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import batch_of, stored, workers_find_package
from claimspark.llm.strassen_mining import LIMB, limbs

LISTS = 4
#: Queries and vectors that are multiplied at a time.
_TILE = 2048
_MOST = (1 << 63) - 1


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part as arrays of floor(scale * x), whole doubles."""
    x = F.col(f"`{vector_column}`").cast("array<double>")

    def floored(c: Column) -> Column:
        y = F.least(F.greatest(c * scale, F.lit(-1e308)), F.lit(1e308))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    whole = F.transform(x, floored)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), whole.alias("v"), fine.alias("ok")).filter(
        "id IS NOT NULL AND ok").select("id", "v")


def _matrix(column: pa.Array, dims: int, dtype: type) -> np.ndarray:
    """Rows of a list column, short rows filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims).astype(dtype)
    out = np.zeros((len(size), dims), dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class _Lists:
    """Partial and total scores of a block of queries against some vectors."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries = ids, queries
        edges = [queries.shape[1] * i // LISTS for i in range(LISTS + 1)]
        self.slices = [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [slice(0, 0)]

    def partial(self, vectors: np.ndarray) -> list[np.ndarray]:
        if self.queries.dtype != object:
            return [self.queries[:, s] @ vectors[:, s].T for s in self.slices]
        return [_wide(self.queries[:, s].astype(float), vectors[:, s].astype(float)) for s in self.slices]

    def best_totals(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """(queries, <= k) totals among the k best of each list, the lowest number where none."""
        parts = self.partial(vectors)
        total = _long(sum(parts))
        parts = [_long(p) for p in parts]  # which entries are resolved need not be exact
        n = len(ids)
        seen = np.zeros(total.shape, bool)
        for p in parts:
            top = np.argpartition(p, n - k, axis=1)[:, n - k:] if n > k else np.tile(np.arange(n), (len(p), 1))
            np.put_along_axis(seen, top, True, axis=1)
        low = np.where(seen & (ids[None, :] != self.ids[:, None]), total, _low(total.dtype))
        return -np.sort(-low, axis=1)[:, :k] if n <= k else -np.sort(-np.partition(low, n - k, axis=1)[:, n - k:], axis=1)

    def reaching(self, ids: np.ndarray, vectors: np.ndarray, cutoff: np.ndarray, k: int):
        """(query row, id, score) of entries that reach the cutoff, at most k a query."""
        parts = self.partial(vectors)
        if parts[0].dtype.kind == "f":
            need = cutoff / len(parts)
        else:  # rounded up without negating the cutoff: the lowest number has no opposite
            need = cutoff // len(parts) + (cutoff % len(parts) > 0)
        # a score at the lower end of a long may be any sum below it
        collected = np.repeat((cutoff <= -_MOST)[:, None], len(ids), axis=1)
        for p in parts:
            collected |= (p >= need[:, None]).astype(bool)
        q, c = np.nonzero(collected)
        score = _long(sum(p[q, c] for p in parts))
        keep = (score >= cutoff[q]) & (ids[c] != self.ids[q])
        q, c, score = q[keep], c[keep], score[keep]
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[c[rank < k]], score[rank < k]


def _wide(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles of any size, as Python's integers."""
    total = np.zeros((len(queries), len(vectors)), object)
    left, right = limbs(queries, 1), limbs(vectors, 1)
    wide = 1 << (62 - 2 * LIMB)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            for d in range(0, a.shape[1], wide):
                total = total + ((a[:, d:d + wide] @ b[:, d:d + wide].T).astype(object) << (LIMB * (i + j)))
    return total


def _long(scores: np.ndarray) -> np.ndarray:
    """Python's integers held within a long; other numbers as they are."""
    if scores.dtype != object:
        return scores
    return np.minimum(np.maximum(scores, -_MOST), _MOST).astype(np.int64)


def _low(dtype: np.dtype) -> float | int:
    """Below every total, for "none" and "no cutoff"."""
    return -np.inf if dtype.kind == "f" else np.iinfo(np.int64).min


def _merge(best: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    both = new if best is None else np.concatenate([best, new], axis=1)
    return -np.sort(-both, axis=1)[:, :k]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, _TILE):
            part = batch.slice(i, _TILE)
            yield part.column(0).to_numpy(), _matrix(part.column(1), dims, dtype)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_column: str = "vec_id",
          vector_column: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for each id divisible by ``every``."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    rows = stored(integers(vectors, id_column, vector_column, scale), "topk-vectors")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.max(F.size("v")).alias("dims"),
                    F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most")).first()
    dims = size["dims"] or 0
    bound = dims * int(size["most"] or 0) ** 2  # of any sum
    dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    blocks = max(1, -(-asked.count() * max(dims, 1) * (48 if dtype is object else np.dtype(dtype).itemsize) // block_bytes))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "topk-queries")
    out = None
    for b in range(blocks):
        part = _block(rows, asked.filter(F.col("block") == b), k, dims, dtype)
        out = part if out is None else out.unionByName(part)
    return out


def _block(rows: DataFrame, asked: DataFrame, k: int, dims: int, dtype: type) -> DataFrame:
    spark = rows.sparkSession
    table = asked.select("id", "v").orderBy("id").toArrow().combine_chunks()
    batch = table.to_batches()
    if batch:
        ids, queries = batch[0].column(0).to_numpy(), _matrix(batch[0].column(1), dims, dtype)
    else:
        ids, queries = np.zeros(0, np.int64), np.zeros((0, dims), dtype)
    shared = spark.sparkContext.broadcast((ids, queries))
    few = min(k, -(-4 * k // max(1, rows.rdd.getNumPartitions())))  # totals a task

    def tiles() -> list[tuple[int, _Lists]]:
        ids, queries = shared.value
        return [(i, _Lists(ids[i:i + _TILE], queries[i:i + _TILE])) for i in range(0, len(ids), _TILE)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, best = tiles(), {}
        for vec_ids, vecs in _blocks(batches, dims, dtype):
            for first, one in lists:
                best[first] = _merge(best.get(first), one.best_totals(vec_ids, vecs, few), few)
        for first, totals in best.items():
            q, c = np.nonzero(totals > _low(totals.dtype))
            yield batch_of(pa.schema([("q", pa.int64()), ("total", pa.int64())]), q + first, totals[q, c].astype(np.int64))

    totals = rows.mapInArrow(gather, "q bigint, total bigint")
    ranked = totals.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"))))
    safe = ranked.filter(F.col("r") == k).select("q", "total").toArrow()  # one row a query of the block
    kind = np.dtype(np.int64 if dtype is object else dtype)  # of scores
    cutoff = np.full(len(ids), _low(kind), kind)
    cutoff[safe.column("q").to_numpy()] = safe.column("total").to_numpy()
    cut = spark.sparkContext.broadcast(cutoff)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = tiles()
        for vec_ids, vecs in _blocks(batches, dims, dtype):
            for first, one in lists:
                q, found, score = one.reaching(vec_ids, vecs, cut.value[first:first + _TILE], k)
                yield batch_of(schema, one.ids[q], found, score.astype(np.int64))

    entries = rows.mapInArrow(collect, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20, scale: int = 64) -> str:
    """DuckDB SQL for ``top_k`` (vectors of equal length, unique ids)."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
