"""SimHash near-duplicate groups with pigeonring filtering.

A document's fingerprint has a bit set when over half of its shingle hashes
(XXH64, seed 42, repeats included) have it.  Fingerprints at ``max_bits`` or
fewer differing bits link; linked documents form a component.

The 64 bits are a ring of m = 2 * max_bits segments.  By the pigeonring
principle (Qin and Xiao, PVLDB 2018) two fingerprints within max_bits have a
start segment from which every chain of l consecutive segments differs in at
most floor(l * max_bits / m) bits.  Candidates are therefore looked up by the
bits of a few segments that some viable chain must leave untouched
(``ring_masks``); each candidate pair must keep the budget of every chain from
that start before its full Hamming distance is counted.  All linking pairs
meet in at least one bucket, so no link is lost.

Scale: equal fingerprints collapse first (partial aggregation), so a group of
copies is one row.  The number of exact segments follows from the number of
distinct fingerprints.  A bucket over ``bucket_rows`` is split by one more
exact segment, then by block pairs; a task holds one bucket at a time and
emits a spanning forest of it, never its pairs.

Defined cases: null or empty text, or one without words: fingerprint zero,
linked like any other.  Fewer words than a shingle: the whole sequence is one
shingle.  Null doc_id: the row is returned, it never names a component (null
if the component has no id at all).  Repeated rows and repeated ids: each row
is returned.  An empty table gives an empty result.  Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import batch_of, drained, stored, text_bytes, workers_find_package
from claimspark.llm.components import components

SEED = 42
#: Up to this size a bucket is compared by shifted copies of itself.
_SMALL = 32


# --- fingerprints ---------------------------------------------------------------

def fingerprint(text: bytes, shingle_words: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return xxh(joined, SEED)
    hashes = np.array([xxh(joined[a:b - 1], SEED) for a, b in zip(starts, starts[shingle_words:])],
                      np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    workers_find_package(docs.sparkSession)
    rows = docs.select("doc_id", text_bytes().alias("text"))
    id_type = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drained(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, fp bigint")


# --- the ring --------------------------------------------------------------------

def segments(max_bits: int) -> list[int]:
    """Bit masks of the ring's segments, of equal width up to one bit."""
    m = 2 * max_bits
    edges = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _viable(diffs: tuple[int, ...], start: int, max_bits: int) -> bool:
    m, total = len(diffs), 0
    for length in range(1, m + 1):
        total += diffs[(start + length - 1) % m]
        if total > length * max_bits // m:
            return False
    return True


def ring_masks(max_bits: int, exact: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, segments) of the buckets: for every way to spread at most
    max_bits differences over the ring there is a viable start whose first
    ``exact`` untouched segments are listed."""
    m = 2 * max_bits
    chosen: dict[tuple[int, tuple[int, ...]], None] = {}
    for touched in range(0, max_bits + 1):
        for where in combinations(range(m), touched):
            for extra in product(range(1, max_bits + 1), repeat=touched):
                if sum(extra) > max_bits:
                    continue
                diffs = [0] * m
                for w, e in zip(where, extra):
                    diffs[w] = e
                for start in range(m):
                    if _viable(tuple(diffs), start, max_bits):
                        ring = [(start + i) % m for i in range(m)]
                        free = tuple([s for s in ring if diffs[s] == 0][:exact])
                        chosen[(start, free)] = None
                        break
    return sorted(chosen)


class _Chains:
    """The chain budgets from each start as arrays."""

    def __init__(self, max_bits: int):
        segs, m = segments(max_bits), 2 * max_bits
        self.max_bits = max_bits
        self.budget = [length * max_bits // m for length in range(1, m + 1)]
        self.mask = np.zeros((m, m), np.uint64)
        for start in range(m):
            bits = 0
            for length in range(m):
                bits |= segs[(start + length) % m]
                self.mask[start, length] = bits

    def keep(self, xor: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indexes of the pairs that hold every chain budget and the distance."""
        alive = np.arange(len(xor))
        for length in range(1, len(self.budget)):
            bits = np.bitwise_count(xor[alive] & self.mask[start[alive], length])
            alive = alive[bits <= self.budget[length]]
            if not len(alive):
                break
        return alive[np.bitwise_count(xor[alive]) <= self.max_bits]


def _forest(fps: np.ndarray, start: int, chains: _Chains) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the pairs of one bucket connect: each reached
    fingerprint is compared with those not reached yet only."""
    out, todo = [], fps
    while len(todo) > 1:
        queue, todo = [todo[:1]], todo[1:]
        while queue and len(todo):
            frontier = queue.pop()
            for one in frontier:
                xor = todo ^ one
                hit = chains.keep(xor, np.full(len(xor), start))
                if len(hit):
                    found = todo[hit]
                    out.append((np.full(len(found), one), found))
                    todo = np.delete(todo, hit)
                    queue.append(found)
                    if not len(todo):
                        break
    return out


def bucket_links(starts: np.ndarray, groups: np.ndarray, fps: np.ndarray,
                 chains: _Chains) -> tuple[np.ndarray, np.ndarray]:
    """Links within consecutive equal ``groups``."""
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    size = np.diff(np.append(edge, len(groups)))
    left, right = [], []
    small = np.repeat((size > 1) & (size <= _SMALL), size)
    if small.any():
        g, f, s = groups[small], fps[small], starts[small]
        for shift in range(1, min(_SMALL, int(size[size <= _SMALL].max()))):
            same = np.flatnonzero(g[shift:] == g[:-shift])
            if not len(same):
                break
            hit = same[chains.keep(f[same] ^ f[same + shift], s[same])]
            left.append(f[hit])
            right.append(f[hit + shift])
    for at, n in zip(edge[size > _SMALL], size[size > _SMALL]):
        for a, b in _forest(fps[at:at + n], int(starts[at]), chains):
            left.append(a)
            right.append(b)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


# --- links and components ----------------------------------------------------------

def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _expand(fps: DataFrame, masks: list[tuple[int, tuple[int, ...]]], segs: list[int]) -> DataFrame:
    entries = [F.struct(F.lit(start).alias("start"), F.lit(_signed(sum(segs[s] for s in free))).alias("mask"))
               for start, free in masks]
    return (fps.select("fp", F.explode(F.array(*entries)).alias("b"))
            .select("fp", "b.start", "b.mask", F.expr("fp & b.mask").alias("key")))


def _hot(rows: DataFrame, bucket_rows: int) -> DataFrame | None:
    sizes = rows.groupBy("start", "mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    sizes = stored(sizes, "hot-buckets")
    return None if sizes.isEmpty() else sizes


def links(fps: DataFrame, max_bits: int, bucket_rows: int = 20_000) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fps`` (column fp) that
    connect exactly the pairs within ``max_bits``."""
    spark = fps.sparkSession
    empty = spark.createDataFrame([], "u bigint, v bigint")
    if max_bits == 0:
        return empty
    segs, m = segments(max_bits), 2 * max_bits
    n = fps.count()
    width = 64 // m
    exact = next((k for k in range(max(1, min(2, max_bits)), max_bits) if n >> (k * width) < 64), max_bits)
    rows, parts = _expand(fps, ring_masks(max_bits, exact), segs), []
    hot = _hot(rows, bucket_rows)
    while hot is not None:
        bucket = ["start", "mask", "key"]
        parts.append(rows.join(hot.select(*bucket), bucket, "left_anti").withColumn("pair", F.lit(0).cast("bigint")))
        rows = rows.join(hot, bucket)
        if exact < max_bits:  # a linking pair leaves max_bits segments untouched, so one more than the bucket's
            exact += 1
            rows = rows.select("fp", "start", "mask", F.explode(F.array(*[F.lit(_signed(s)) for s in segs])).alias("s"))
            rows = rows.filter("(mask & s) = 0").select(
                "fp", "start", F.expr("mask | s").alias("mask"), F.expr("fp & (mask | s)").alias("key")).distinct()
            hot = _hot(rows, bucket_rows)
        else:  # block against block
            blocks = F.ceil(F.col("n") / bucket_rows)
            mine = F.pmod(F.xxhash64("fp"), blocks)
            other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
            rows = (rows.withColumn("mine", mine).withColumn("other", other)
                    .withColumn("pair", F.least("mine", "other") * 4294967296 + F.greatest("mine", "other"))
                    .select("fp", *bucket, "pair"))
            parts.append(rows)
            rows, hot = None, None
    if rows is not None:
        parts.append(rows.withColumn("pair", F.lit(0).cast("bigint")))
    buckets = parts[0]
    for p in parts[1:]:
        buckets = buckets.unionByName(p)
    chains = _Chains(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held: list[np.ndarray] | None = None

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            start, mask, key, pair, fp = cols
            change = (start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            group = np.concatenate([[0], np.cumsum(change)])
            a, b = bucket_links(start, group, fp.view(np.uint64), chains)
            a, b = a.view(np.int64), b.view(np.int64)
            return batch_of(schema, np.maximum(a, b), np.minimum(a, b))

        for batch in drained(batches):
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            differs = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                differs |= c != c[-1]
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if last:
                yield found([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield found(held)

    order = ["start", "mask", "key", "pair"]
    return (buckets.select(F.col("start").cast("bigint"), "mask", "key", "pair", "fp")
            .repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "u bigint, v bigint").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4,
                    bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    tree = components(links(fps.select("fp"), max_bits, bucket_rows))
    rooted = fps.join(tree, fps["fp"] == tree["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted-fingerprints")
    # stored: as a table of its own it is one side of a join that can be split at a giant component
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named-components")
    lookup = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(lookup, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents without those whose component has a smaller id.  Rows
    without an id stay; rows that share an id stay or go together."""
    groups = near_duplicates(docs, shingle_words, max_bits)
    dropped = groups.filter("doc_id > component_id").select("doc_id").distinct()
    kept = groups.filter("doc_id = component_id").select("doc_id")
    return docs.join(dropped.join(kept, "doc_id", "left_anti"), "doc_id", "left_anti").select(*docs.columns)
