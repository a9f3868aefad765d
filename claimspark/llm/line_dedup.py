"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

``LineIndex`` holds three tables in the shared folder:

* ``refs``: which document holds which line key, one row per pair;
* ``counts``: the exact reference count of each key and the largest document
  holding it (the keeper);
* ``filters``: per shard of the key space a cuckoo filter of the repeated keys
  (count >= ``min_docs``).

``insert`` and ``delete`` change the counts by the batch's pre-aggregated
deltas and insert into or delete from the filters just the keys that crossed
the threshold, so deleting documents gives the index that never saw them.
``drops`` sends each line reference past its shard's filter first; only what
the filter lets through is joined with the exact counts, which settle it.

Scale: a key's references are reduced by partial aggregation, the exact join
is an equi-join that adaptive execution splits when one key is hot, and a
filter shard holds about ``keys_per_shard`` keys.  Filters are broadcast in
blocks of at most ``block_bytes`` whatever their total size.  Texts are shuffled once,
by doc_id.  Keys are 128-bit hashes (XXH3) of the normalised line; two different
lines among n share one with a probability of about n^2 / 2^129.

Defined cases: null or empty text is one empty line.  Rows without a doc_id
take no part and stay as they are.  Rows that repeat a doc_id are one document
(a key counts once for it, and all its rows lose or keep the key together).
An empty table gives an empty result.  Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import drained, stored, text_bytes, workers_find_package

REF = "k1 bigint, k2 bigint, doc_id bigint"
_SLOTS = 4
_MAX_KICKS = 200


# --- keys ----------------------------------------------------------------------

def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of a line, None if its normal form is shorter than ``min_chars``."""
    norm = line.strip().lower()  # bytes: ASCII white space and letters only
    if len(norm) < min_chars or (len(norm) < 4 * min_chars and len(norm.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(norm)


def line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id): the distinct keys of each row that has a doc_id."""
    workers_find_package(docs.sparkSession)
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drained(batches):
            keys, owners = [], []
            for i, text in enumerate(batch.column(1)):
                own = {line_key(x, min_chars) for x in text.as_py().split(b"\n") if len(x) >= min_chars}
                own.discard(None)
                keys += own
                owners += [i] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), batch.column(0).take(pa.array(owners, pa.int64()))],
                names=["k1", "k2", "doc_id"])

    return rows.mapInArrow(run, REF)


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("k1", 20), F.lit(shards)).cast("int")


# --- the filter ------------------------------------------------------------------

class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket.  Keys that find
    no place after ``_MAX_KICKS`` moves go to an exact stash."""

    def __init__(self, cells: np.ndarray, stash: set[tuple[int, int]]):
        self.cells, self.stash = cells, stash

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1
        while buckets * _SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, _SLOTS), np.uint16), set())

    @classmethod
    def load(cls, cells: bytes, stash: bytes) -> Cuckoo:
        pairs = np.frombuffer(stash, np.int64).reshape(-1, 2)
        return cls(np.frombuffer(cells, np.uint16).reshape(-1, _SLOTS).copy(), {tuple(p) for p in pairs.tolist()})

    def dump(self) -> tuple[bytes, bytes]:
        return self.cells.tobytes(), np.array(sorted(self.stash), np.int64).tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        mark = (k2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        mask = np.uint64(len(self.cells) - 1)
        one = (k1.view(np.uint64) & mask).astype(np.int64)
        return mark, one, one ^ self.jump(mark)

    def jump(self, mark: np.ndarray) -> np.ndarray:
        spread = (np.asarray(mark, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        return (spread & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for a, b, mark, one, two in zip(k1.tolist(), k2.tolist(), *self.places(k1, k2)):
            if not (self._put(one, mark) or self._put(two, mark)):
                self._kick(a, b, int(one), mark)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.cells[bucket] == 0)
        if len(free):
            self.cells[bucket, free[0]] = mark
        return bool(len(free))

    def _kick(self, k1: int, k2: int, bucket: int, mark: int) -> None:
        trail = []
        for turn in range(_MAX_KICKS):
            slot = (k2 + turn) & (_SLOTS - 1)
            trail.append((bucket, slot, mark))
            mark, self.cells[bucket, slot] = self.cells[bucket, slot], mark
            bucket = int(bucket ^ self.jump(mark))
            if self._put(bucket, mark):
                return
        for at, slot, put in reversed(trail):  # undo, so that only this key is stashed
            mark, self.cells[at, slot] = self.cells[at, slot], mark
            assert mark == put
        self.stash.add((k1, k2))

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for a, b, mark, one, two in zip(k1.tolist(), k2.tolist(), *self.places(k1, k2)):
            if (a, b) in self.stash:
                self.stash.remove((a, b))
                continue
            for bucket in (one, two):
                hit = np.flatnonzero(self.cells[bucket] == mark)
                if len(hit):
                    self.cells[bucket, hit[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """False only for keys that are surely not in the filter."""
        mark, one, two = self.places(k1, k2)
        found = ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)
        if self.stash:
            found |= np.fromiter(((a, b) in self.stash for a, b in zip(k1.tolist(), k2.tolist())), bool, len(k1))
        return found


_FILTER = "shard int, items bigint, cells binary, stash binary"


def _filter_row(shard: int, items: int, cuckoo: Cuckoo) -> pd.DataFrame:
    cells, stash = cuckoo.dump()
    return pd.DataFrame({"shard": [shard], "items": [items], "cells": [cells], "stash": [stash]})


# --- the index -------------------------------------------------------------------

@dataclass(frozen=True)
class LineIndex:
    """An immutable version of the index; changes return the next version."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = 5
    min_chars: int = 40
    block_bytes: int = 64 << 20

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40,
              keys_per_shard: int = 50_000, block_bytes: int = 64 << 20) -> LineIndex:
        refs = stored(line_refs(docs, min_chars), "line-refs")
        counts = stored(_counted(refs.distinct()), "line-counts")
        repeated = counts.filter(F.col("n") >= min_docs).count()
        shards = max(1, -(-repeated // keys_per_shard))
        empty = refs.sparkSession.createDataFrame([], _FILTER)
        index = cls(refs, counts, empty, shards, min_docs, min_chars, block_bytes)
        return replace(index, filters=index._rebuilt(counts))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; references that are already known change nothing."""
        pair = ["k1", "k2", "doc_id"]
        new = stored(line_refs(docs, self.min_chars).distinct().join(self.refs, pair, "left_anti"), "line-refs-new")
        delta = _counted(new).select("k1", "k2", F.col("n").alias("d"), F.col("keeper").alias("top"))
        counts = stored(self.counts.join(delta, ["k1", "k2"], "full").select(
            "k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"),
            F.greatest("keeper", "top").alias("keeper")), "line-counts")
        refs = stored(self.refs.unionByName(new), "line-refs")
        return replace(self, refs=refs, counts=counts, filters=self._updated(counts))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents (column doc_id) out; unknown ids change nothing."""
        ids = doc_ids.select("doc_id").distinct()
        # stored, so that the joins with it can be split at a line of very many documents
        touched = stored(self.refs.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
        refs = stored(self.refs.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "line-refs")
        again = _counted(refs.distinct().join(touched, ["k1", "k2"], "left_semi"))
        counts = stored(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again), "line-counts")
        return replace(self, refs=refs, counts=counts, filters=self._updated(counts))

    def _updated(self, counts: DataFrame) -> DataFrame:
        """The filters after ``counts`` replaces this version's counts: shards
        with room take the crossing keys, full ones are built anew."""
        held = self.counts.filter(F.col("n") >= self.min_docs).select("k1", "k2", F.lit(1).alias("was"))
        now = counts.filter(F.col("n") >= self.min_docs).select("k1", "k2", F.lit(1).alias("is"))
        crossing = held.join(now, ["k1", "k2"], "full").filter("was IS NULL OR is IS NULL").select(
            shard_of(self.shards).alias("shard"), "k1", "k2", F.col("is").isNotNull().alias("add"))
        crossing = stored(crossing, "line-crossing")
        sizes = crossing.groupBy("shard").agg(F.sum(F.when(F.col("add"), 1).otherwise(-1)).alias("change"))
        room = F.floor(F.length("cells") / 2 * F.lit(0.9))  # two bytes a slot
        state = self.filters.join(sizes, "shard", "full").select(
            "shard", (F.col("cells").isNull() | (F.col("items") + F.col("change") > room)).alias("full"))
        full = stored(state.filter("full").select("shard"), "line-full-shards")

        def change(key: tuple, have: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(have):
                return pd.DataFrame({"shard": [], "items": [], "cells": [], "stash": []})
            cuckoo = Cuckoo.load(have.cells.iloc[0], have.stash.iloc[0])
            gone, new = keys[~keys["add"]], keys[keys["add"]]
            cuckoo.delete(gone.k1.to_numpy(), gone.k2.to_numpy())
            cuckoo.insert(new.k1.to_numpy(), new.k2.to_numpy())
            return _filter_row(key[0], int(have["items"].iloc[0]) + len(new) - len(gone), cuckoo)

        kept = self.filters.join(full, "shard", "left_anti")
        moved = crossing.join(full, "shard", "left_anti")
        changed = kept.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, _FILTER)
        rebuilt = self._rebuilt(counts.join(full, shard_of(self.shards) == full["shard"], "left_semi"))
        return stored(changed.unionByName(rebuilt), "line-filters")

    def _rebuilt(self, counts: DataFrame) -> DataFrame:
        """Filters of the repeated keys of ``counts``, one row per shard."""

        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            cuckoo = Cuckoo.sized(len(keys))
            cuckoo.insert(keys.k1.to_numpy(), keys.k2.to_numpy())
            return _filter_row(key[0], len(keys), cuckoo)

        keys = counts.filter(F.col("n") >= self.min_docs).select(shard_of(self.shards).alias("shard"), "k1", "k2")
        return stored(keys.groupBy("shard").applyInPandas(build, _FILTER), "line-filters")

    def maybe_repeated(self, refs: DataFrame) -> DataFrame:
        """The references whose shard's filter holds their key."""
        spark = refs.sparkSession
        sizes = self.filters.select("shard", (F.length("cells") + F.length("stash")).alias("b"))
        total = sizes.agg(F.sum("b")).first()[0] or 0
        per_block = max(1, int(self.shards * min(1.0, self.block_bytes / max(total, 1))))
        out = None
        for start in range(0, self.shards, per_block):
            block = self.filters.filter(F.col("shard").between(start, start + per_block - 1)).toArrow()
            shared = spark.sparkContext.broadcast(
                {s: (c, x) for s, c, x in zip(*(block.column(n).to_pylist() for n in ("shard", "cells", "stash")))})

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                filters = {s: Cuckoo.load(*x) for s, x in shared.value.items()}
                for batch in drained(batches):
                    k1, k2, shard = (batch.column(i).to_numpy() for i in (0, 1, 3))
                    keep = np.zeros(batch.num_rows, bool)
                    order = np.argsort(shard, kind="stable")
                    edges = np.flatnonzero(np.diff(shard[order])) + 1
                    for rows in np.split(order, edges):
                        if len(rows) and (one := filters.get(int(shard[rows[0]]))):
                            keep[rows] = one.holds(k1[rows], k2[rows])
                    yield batch.filter(pa.array(keep)).select(["k1", "k2", "doc_id"])

            rows = refs.select("k1", "k2", "doc_id", shard_of(self.shards).alias("shard"))
            if per_block < self.shards:
                rows = rows.filter(F.col("shard").between(start, start + per_block - 1))
            part = rows.mapInArrow(run, REF)
            out = part if out is None else out.unionByName(part)
        return out

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, k1, k2) lists: the keys each document loses, one row per document."""
        maybe = self.maybe_repeated(self.refs if refs is None else refs)
        exact = self.counts.filter(F.col("n") >= self.min_docs).select("k1", "k2", "keeper")
        lost = maybe.join(exact, ["k1", "k2"]).filter("doc_id != keeper")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("k")).select(
            "doc_id", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))


# --- rewriting documents -----------------------------------------------------------

N_LINES, N_DROPPED, _K1, _K2 = "__llm_lines", "__llm_dropped", "__llm_k1", "__llm_k2"


def rewrite(docs: DataFrame, drops: DataFrame, min_chars: int = 40) -> DataFrame:
    """``docs`` with the dropped lines removed from text, plus the columns
    ``N_LINES`` and ``N_DROPPED``."""
    workers_find_package(docs.sparkSession)
    plan = drops.select(F.col("doc_id").alias("__llm_id"), F.col("k1").alias(_K1), F.col("k2").alias(_K2))
    joined = docs.join(plan, F.col("doc_id").cast("bigint") == F.col("__llm_id"), "left").drop("__llm_id")
    at = joined.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(N_LINES, T.LongType()),
                           T.StructField(N_DROPPED, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drained(batches):
            texts = batch.column(at)
            k1, k2 = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            lines, dropped = np.ones(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            out = []
            for i, text in enumerate(texts):
                text = text.as_py()
                lines[i] = (text or "").count("\n") + 1
                if text and k1[i].is_valid:
                    lost = set(zip(k1[i].as_py(), k2[i].as_py()))
                    kept = []
                    for line in text.split("\n"):
                        key = line_key(line.encode(), min_chars)
                        if key is None or (int.from_bytes(key[:8], "little", signed=True),
                                           int.from_bytes(key[8:], "little", signed=True)) not in lost:
                            kept.append(line)
                    dropped[i] = lines[i] - len(kept)
                    text = "\n".join(kept)
                out.append(text)
            columns = [c if i != at else pa.array(out, texts.type)
                       for i, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(dropped)],
                                             names=[f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` after the dedup of its own lines, with the two count columns."""
    index = LineIndex.build(docs, min_docs, min_chars)
    return rewrite(docs, index.drops(), min_chars)


def dedup_report(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", F.col(N_LINES).alias("n_lines"), F.col(N_DROPPED).alias("n_dropped"),
                      F.sha2(text_bytes(), 256).alias("kept_sha256"))


def oracle(min_docs: int = 5, min_chars: int = 40) -> str:
    """DuckDB SQL for ``dedup_report`` (rows without a doc_id aside)."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{lower}') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {min_chars}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.*, bad.key IS NOT NULL AND doc_id <> keeper AS lost FROM k LEFT JOIN bad ON bad.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
