"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir`` (``stored``), so a lost executor never costs more
than the tasks it was running.  Nothing here caches by path or keeps state
between calls.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import stored  # noqa: F401

#: Bytes of text that one vectorised step handles; larger Arrow batches are cut
#: between documents, so memory is bounded by this plus the longest document.
STEP_BYTES = 1 << 19


def workers_find_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path.

    Enough where the folder exists on every machine, as in local runs; a cluster
    gets the package by ``--py-files`` or its image like any other library.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty: what the Arrow operators read."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))


def held_out(key: str, modulus: int, remainder: int = 1) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % modulus == remainder


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, length n + 1) of a binary Arrow array without nulls."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def drained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one Arrow's unused memory goes back to the
    system, since the worker stays for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def steps(batches: Iterator[pa.RecordBatch], text: str = "text",
          limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each slice has about ``limit`` bytes of text."""
    for batch in drained(batches):
        if batch.num_rows == 0:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)
