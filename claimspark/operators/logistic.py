"""L2-regularised logistic regression by Newton steps over all rows.

Minimises sum log(1 + exp(-margin)) + l2 / 2 * |weights|^2 (the intercept is
free).  A step needs the gradient and the weighted Gram matrix of the features:
each task adds them up over its rows, and the driver sums the tasks' cells and
solves one system of (features + 1) unknowns.  A step that would raise the loss is
halved.  Second-order steps converge in about ten passes over the rows, whatever their
number.  For these Spark keeps the rows on the executors' disks in blocks in which a
column of few different values takes a byte a row; a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    names: list[str]
    weights: list[float]
    intercept: float
    steps: int
    gradient: float  # the largest component of the gradient at the solution, a row

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in zip(self.names, self.weights):
            out = out + F.lit(w) * F.col(f"`{name}`")
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` and ``prediction``."""
        return df.withColumn("probability", 1 / (1 + F.exp(-self.margin()))).withColumn(
            "prediction", (F.col("probability") > 0.5).cast("int"))


BLOCK_ROWS = 1 << 13
#: A column with up to so many different values in a block is kept as a byte a row.
_CODES = 256


def _packed(columns: Sequence[pa.Array]) -> bytes:
    """A block of rows without loss: their number, that of each column's different values
    (0: not coded), these values or the whole columns, then the codes."""
    head, values, codes = [len(columns[0])], [], []
    for column in columns:
        coded = column.dictionary_encode()
        few = len(coded.dictionary) <= _CODES
        head.append(len(coded.dictionary) if few else 0)
        values.append((coded.dictionary if few else column).to_numpy(zero_copy_only=False).tobytes())
        if few:
            codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
    return b"".join([np.array(head, np.int64).tobytes(), *values, *codes])


def _unpacked(block: bytes, columns: int) -> np.ndarray:
    """(columns + 1, rows): the columns and a 1."""
    head = np.frombuffer(block, np.int64, columns + 1)
    rows, kept = int(head[0]), np.where(head[1:] > 0, head[1:], head[0]).tolist()
    out = np.empty((columns + 1, rows))
    out[-1] = 1
    at, codes_at = head.nbytes, head.nbytes + 8 * sum(kept)
    for row, few, n in zip(out, head[1:].tolist(), kept):
        values = np.frombuffer(block, np.float64, n, at)
        at += values.nbytes
        if few:
            np.take(values, np.frombuffer(block, np.uint8, rows, codes_at), out=row)
            codes_at += rows
        else:
            row[:] = values
    return out


def _blocks(rows: DataFrame) -> RDD:
    """``rows`` (label, features) in packed blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = _packed(batch.slice(at, BLOCK_ROWS).columns)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary").rdd.map(lambda row: bytes(row[0]))


def _sums(blocks: RDD, beta: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and Gram matrix at ``beta``, summed over all rows in the
    order of the tasks."""
    k = len(beta)

    def add(found: Iterator[bytes]) -> list[np.ndarray]:
        total = np.zeros(2 + k + k * k)
        for block in found:
            columns = _unpacked(block, k)
            y, x = columns[0], columns[1:]
            margin = beta @ x
            small = np.exp(-np.abs(margin))
            p = np.where(margin < 0, small, 1) / (1 + small)
            total[0] += len(y)
            total[1] += (np.log1p(small) + np.maximum(margin, 0) - np.where(y > 0, margin, 0)).sum()
            total[2:2 + k] += x @ (p - y)
            total[2 + k:] += ((x * (p * (1 - p))) @ x.T).ravel()
        return [total]

    return np.sum(blocks.mapPartitions(add).collect() or [np.zeros(2 + k + k * k)], axis=0)  # (features + 2)^2 cells a task


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label", l2: float = 1.0, max_steps: int = 100,
                 tolerance: float = 1e-10) -> LogisticFit:
    """Fit on every row of ``df`` (features scaled, no nulls); stops when no component
    of the gradient exceeds ``tolerance`` a row.  Without rows all weights are 0."""
    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_x{i}")
                                                               for i, c in enumerate(features)])
    k = len(features) + 1
    penalty = np.append(np.full(k - 1, l2), 0.0)
    beta, before, step, size, taken = np.zeros(k), np.inf, np.zeros(k), 1.0, 0
    blocks = _blocks(rows).persist(StorageLevel.DISK_ONLY)  # read in order a few times: room in memory is for the tasks
    try:
        for taken in range(1, max_steps + 1):
            found = _sums(blocks, beta)
            n = max(1, int(found[0]))
            loss = found[1] + 0.5 * (penalty * beta) @ beta
            if loss > before * (1 + 1e-12) and size > 1e-6:  # too far: half the step
                size /= 2
                beta = beta - size * step
                continue
            gradient = found[2:2 + k] + penalty * beta
            if np.abs(gradient).max() <= tolerance * n:
                break
            gram = found[2 + k:].reshape(k, k) + np.diag(penalty) + 1e-12 * n * np.eye(k)
            step, size, before = -np.linalg.solve(gram, gradient), 1.0, loss
            beta = beta + step
    finally:
        blocks.unpersist()
    return LogisticFit(list(features), beta[:-1].tolist(), float(beta[-1]), taken, float(np.abs(gradient).max() / n))
