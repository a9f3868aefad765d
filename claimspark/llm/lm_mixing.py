"""Language-model scoring by online logistic context mixing.

A token (lower-cased word, or the end of the text) is coded as eight binary
decisions that spell its class, then as one of its class by the corpus counts:

    P(token | history) = prod_b P(bit_b | history) * (c + 0.5) / (C + 0.5 * (V + 1))

The ``OWN`` most frequent tokens are classes of their own, the others are
hashed to the remaining classes.  Each bit is predicted by several contexts:
none, the previous token, the two previous tokens (with the exact counts of the
whole training corpus) and the token that followed the same two tokens
earlier in this text.  Their
log-odds are added with weights that a gate selects (bit number and state of
the match).  Weights start from values learned online on all training texts
(every task learns, its results are averaged by tokens) and go on adapting to
each text, block by block, using nothing but what came before.

Scale: word counts are summed per 64-bit word key; the ``head_words`` most
frequent keys are broadcast (a fixed size), all other words of a text are joined
with the exact counts.  What followed each context is a table (context, class,
count) that grows with the corpus's different contexts and is never gathered in
one place: texts are dealt to chunks of ``CHUNK_BYTES``, each chunk's different
contexts are joined with the table, and a chunk is scored beside its own part.
A context seen once goes only to chunks of texts outside the training set; in a
training text a missing context has been seen there alone.  Two of n different
contexts share a 64-bit key with a probability of about n^2 / 2^65.

Defined cases: null or empty text has only its end token.  A null id counts as
'' in the split.  Repeated rows are scored each.  An empty table gives an
empty result; without training texts every count is 0.  Only doc_id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from claimspark.llm import textvec
from claimspark.llm.common import STEP_BYTES, batch_of, buffers, drained, held_out, steps, stored, text_bytes, workers_find_package

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
OWN, HASHED = 128, 128
BITS = 8
#: Gates of a bit: no match, match agreeing so far, match that failed.
GATES = 3
PREDICTORS = 4
BLOCK_TOKENS, GROUP_DOCS = 256, 128
RATE = 0.3
#: Text of a chunk, which is scored beside the counts of its contexts.
CHUNK_BYTES = 8 << 20
_HELD_TOGETHER = 2_000_000
#: Shares of the chunks that are learned from, and scored, one after the other.
ROUNDS = 2
#: Tokens of a part of the cells, bits that may number the parts.
PART_TOKENS, MOST_PART_BITS = 1 << 20, 13
#: Bits of a word's rank in a cell; the rank that stands for no word.
RANK_BITS = 21
NO_WORD = (1 << RANK_BITS) - 1
#: A byte that says that the count is so large or larger.
LARGE = 255
MATCH_LOGIT = 2.0

# What a class spells, (classes, BITS): the place of each decision in the class
# tree, its bit, the bit's sign.
_CLASS = np.arange(1 << BITS)[:, None]
_LEVEL = np.arange(BITS)
_NODE = (1 << _LEVEL) | (_CLASS >> (BITS - _LEVEL))
_BIT = (_CLASS >> (BITS - 1 - _LEVEL)) & 1
_SIGN = (2 * _BIT - 1).astype(np.float32)
#: How many leading bits agree, by the exclusive or of two classes.
_AGREE = np.array([BITS - int(x).bit_length() for x in range(1 << BITS)], np.int64)


# --- tokens ------------------------------------------------------------------------

def token_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts, and where each text's tokens start."""
    data, offsets = buffers(column)
    data = textvec.LOWER[data]
    words = textvec.split(data, offsets)
    n = len(column)
    first = words.first + np.arange(n + 1)
    keys = np.empty(len(words.start) + n, np.uint64)
    keys[np.arange(len(words.start)) + words.doc] = textvec.keys(data, words)
    keys[first[1:] - 1] = END
    return keys, first


class Classes:
    """The frequent tokens with a class of their own, found by 16 bits of the key."""

    def __init__(self, keys: np.ndarray, number: np.ndarray):
        self.keys, self.number = keys, number
        self.layers = []  # tables from the leading bits to a frequent token; equal bits go to the next
        left = np.arange(len(keys))
        while len(left):
            table = np.full(1 << 16, -1, np.int16)
            lead = (keys[left] >> np.uint64(48)).astype(np.int64)
            table[lead] = left
            self.layers.append(table)
            left = left[table[lead] != left]

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = (OWN + (keys & np.uint64(HASHED - 1)).astype(np.int64)).astype(np.int32)
        lead = (keys >> np.uint64(48)).astype(np.int64)
        for table in self.layers:
            at = table[lead]
            maybe = np.flatnonzero(at >= 0)
            hit = maybe[self.keys[at[maybe]] == keys[maybe]]
            out[hit] = self.number[at[hit]]
        return out


def contexts(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the one and two tokens before each token of its text."""
    one = np.empty_like(keys)
    one[1:] = keys[:-1]
    one[first[:-1]] = START
    before = np.empty_like(keys)
    before[1:] = one[:-1]
    before[first[:-1]] = START
    return one, textvec.combine(before, one)


def matches(classes: np.ndarray, two: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class that followed the same two tokens before in the text, else -1."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    place = textvec.combine(two, text)
    cell = (place >> np.uint64(44)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cell)[cell] > 1)  # a place seen once shares its cell at most by chance
    order = maybe[np.argsort(place[maybe], kind="stable")]
    same = place[order][1:] == place[order][:-1]
    out = np.full(len(classes), -1, np.int32)
    out[order[1:][same]] = classes[order[:-1][same]]
    return out


# --- chunks of coded texts ------------------------------------------------------------

def _planes(*columns: np.ndarray) -> bytes:
    """The columns byte by byte of their numbers: leading zeros lie together, for a codec."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _from_planes(data: np.ndarray, *kinds: type) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at:at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _shut(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _opened(data: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8)


def coded(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rows`` (doc_id, held_out, text) as one row per chunk: its texts split once, each
    token the place of its word in the chunk's dictionary, frequent words first.  ``uid``
    numbers the first text, ``n`` counts each word in the training texts."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ddl = (f"chunk bigint, uid bigint, doc_id array<{id_type}>, held_out array<boolean>, n_bytes array<bigint>, "
           "n_tokens array<bigint>, tokens bigint, words bigint, word binary, n binary, token binary")
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def chunk_of(number: int, uid: int, batches: list[pa.RecordBatch], found: list) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in found])
        n_tokens = np.concatenate([np.diff(f) for _, f in found])
        out = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
        word, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        at, word = place[at], word[order]
        n = np.bincount(at[np.repeat(~out, n_tokens)], minlength=len(word)).astype(np.uint32)
        ids = pa.concat_arrays([b.column(0) for b in batches]).cast(schema.field("doc_id").type.value_type)
        size = np.concatenate([np.diff(buffers(b.column(2))[1]) for b in batches])
        whole = [pa.array([0, len(out)], pa.int32())]
        columns = [number, uid, ids, pa.array(out), pa.array(size), pa.array(n_tokens.astype(np.int64)), len(keys), len(word),
                   _shut(_planes(np.diff(word, prepend=np.uint64(0)))), _shut(_planes(n)), _shut(_planes(at))]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(*whole, c).cast(f.type) if isinstance(c, pa.Array) else pa.array([c], f.type)
             for c, f in zip(columns, schema)], schema=schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = number = TaskContext.get().partitionId() << 33
        waiting, found, held = [], [], 0
        for batch in steps(batches, limit=min(chunk_bytes, STEP_BYTES)):
            size = int(buffers(batch.column(2))[1][-1])
            if held and held + size > chunk_bytes:
                yield chunk_of(number, uid, waiting, found)
                number, uid = number + 1, uid + sum(b.num_rows for b in waiting)
                waiting, found, held = [], [], 0
            held += size
            waiting.append(batch)
            found.append(token_keys(batch.column(2)))
        if waiting:
            yield chunk_of(number, uid, waiting, found)

    return rows.mapInArrow(code, T.StructType.fromDDL(ddl))


def _dictionary(row: dict) -> np.ndarray:
    step, = _from_planes(_opened(row["word"], 8 * row["words"]), np.uint64)
    return np.cumsum(step, dtype=np.uint64)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows as dictionaries; binary values stay Arrow buffers, lists Arrow arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns):
            value = column[i]
            row[name] = value.as_buffer() if pa.types.is_binary(value.type) else value.values if pa.types.is_list(value.type) else value.as_py()
        yield row


# --- word counts -------------------------------------------------------------------

def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    held_k, held_n, limit = [], [], 4_000_000

    def merge() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(held_k), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(held_n), minlength=len(keys)).astype(np.int64)

    for batch in batches:
        for row in _rows(batch):
            n, = _from_planes(_opened(row["n"], 4 * row["words"]), np.uint32)
            held_k.append(_dictionary(row)[n > 0])
            held_n.append(n[n > 0])
            if sum(map(len, held_k)) > limit:
                keys, n = merge()
                if len(keys) > limit // 2:
                    yield batch_of(schema, keys.view(np.int64), n)
                    held_k, held_n = [], []
                else:
                    held_k, held_n = [keys], [n]
    if held_k:
        keys, n = merge()
        yield batch_of(schema, keys.view(np.int64), n)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(key, n) over the training texts of ``coded`` chunks."""
    return (chunks.select("words", "word", "n").mapInArrow(_summed, "key bigint, n bigint")
            .groupBy("key").agg(F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """What the scorers know of the counts: totals, the head, class totals."""

    tokens: int
    words: int
    keys: np.ndarray  # of the head, ascending
    n: np.ndarray
    classes: Classes
    class_log: np.ndarray  # log10 of each class's denominator
    class_n: np.ndarray  # tokens of each class

    def __post_init__(self):
        self.logs = np.log10(self.n + 0.5)
        self.index = np.searchsorted(self.keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.index = np.append(self.index, len(self.keys))
        self.rank = np.empty(len(self.keys), np.int64)  # 0 for the most frequent
        self.rank[np.lexsort((self.keys, -self.n))] = np.arange(len(self.keys))

    def __reduce__(self):  # workers derive the rest themselves
        return Vocabulary, (self.tokens, self.words, self.keys, self.n, self.classes, self.class_log, self.class_n)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the head, -1 for others."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        top = (keys >> np.uint64(64 - 20)).astype(np.int64)
        at, end = self.index[top], self.index[top + 1]
        todo = np.arange(len(keys))
        while len(todo):
            todo = todo[at[todo] < end[todo]]
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return out


def vocabulary(counts: DataFrame, head_words: int) -> Vocabulary:
    totals = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("shiftleft(1L, cast(floor(log2(n)) as int))"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # about a thousand rows
    least, room = 1 << 62, head_words
    for row in sorted(sizes, key=lambda r: -r["level"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["level"]
    head = counts.filter(F.col("n") >= least).toArrow()
    keys = head.column("key").to_numpy().view(np.uint64)
    n = head.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    top = np.sort(np.lexsort((keys, -n))[:OWN])
    classes = Classes(keys[top], np.argsort(np.argsort(-n[top], kind="stable")).astype(np.int32))
    total = np.zeros(OWN + HASHED)
    kinds = np.zeros(OWN + HASHED)
    group = F.expr(f"{OWN} + (key & {HASHED - 1})")
    for row in counts.groupBy(group.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[row["c"]], kinds[row["c"]] = row["n"], row["v"]
    hashed = (OWN + (keys[top] & np.uint64(HASHED - 1))).astype(np.int64)
    np.subtract.at(total, hashed, n[top])
    np.subtract.at(kinds, hashed, 1)
    total[classes.number] = n[top]
    class_log = np.log10(total + 0.5 * (kinds + 1))
    class_log[classes.number] = np.log10(n[top] + 0.5)  # one token: certain
    return Vocabulary(totals["n"] or 0, totals["v"], keys, n, classes, class_log, total)


# --- contexts ------------------------------------------------------------------------

def tree_counts(class_n: np.ndarray) -> np.ndarray:
    """(2, 2^BITS): how often bit 0 and bit 1 was seen at each place of the class tree."""
    out = np.zeros((2, 1 << BITS))
    for bit in (0, 1):
        np.add.at(out[bit], _NODE[_BIT == bit], np.broadcast_to(class_n[:, None], _BIT.shape)[_BIT == bit])
    return out.astype(np.float32)


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rows`` (doc_id, held_out, text) with the chunk and a number of each."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("uid", T.LongType()), *rows.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = chunk = TaskContext.get().partitionId() << 33
        held = 0
        for batch in steps(batches, limit=min(chunk_bytes, STEP_BYTES)):
            size = int(buffers(batch.column(2))[1][-1])
            if held and held + size > chunk_bytes:
                chunk, held = chunk + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, chunk)), pa.array(uid + np.arange(batch.num_rows)), *batch.columns],
                names=schema.names)
            uid += batch.num_rows

    return rows.mapInArrow(deal, schema)


def context_counts(training: DataFrame, classes: Classes) -> DataFrame:
    """(context, total, seen): of every context of the training texts how many tokens
    followed, and of which classes (256 * count + class)."""
    schema = pa.schema([("context", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            context, cls = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((cls, context))
            context, cls = context[order], cls[order]
            edge = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (cls[1:] != cls[:-1])))
            return batch_of(schema, context[edge].view(np.int64), cls[edge], np.diff(np.append(edge, len(cls))))

        for batch in steps(batches):
            keys, first = token_keys(batch.column(0))
            cls = classes.of(keys)
            held += [(context, cls) for context in contexts(keys, first)]
            if sum(len(c) for c, _ in held) > _HELD_TOGETHER:
                yield summed()
        if held:
            yield summed()

    return (training.mapInArrow(count, "context bigint, class int, n bigint").repartition("context")
            .groupBy("context", "class").agg(F.sum("n").alias("n"))
            .groupBy("context").agg(F.sum("n").alias("total"), F.collect_list(F.expr("256 * n + class")).alias("seen")))


def context_needs(chunks: DataFrame) -> DataFrame:
    """(chunk, held_out, context): the contexts of each chunk, once or a few times."""
    schema = pa.schema([("chunk", pa.int64()), ("held_out", pa.bool_()), ("context", pa.int64())])

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def once() -> pa.RecordBatch:
            context, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((context, place))
            context, place = context[order], place[order]
            edge = np.append(True, (context[1:] != context[:-1]) | (place[1:] != place[:-1]))
            context, place = context[edge], place[edge]
            return batch_of(schema, place >> 1, (place & 1).astype(bool), context.view(np.int64))

        for batch in steps(batches):
            keys, first = token_keys(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.repeat(2 * batch.column(0).to_numpy() + out, np.diff(first))
            held += [(context, place) for context in contexts(keys, first)]
            if sum(len(c) for c, _ in held) > _HELD_TOGETHER:
                yield once()
        if held:
            yield once()

    return chunks.select("chunk", "held_out", "text").mapInArrow(need, "chunk bigint, held_out boolean, context bigint")


def chunk_contexts(chunks: DataFrame, classes: Classes, bits: int) -> DataFrame:
    """(part, chunk, held_out, cells): the contexts of each chunk, sorted and packed,
    a part for each value of their first ``bits`` bits.  Those of training texts come with
    the classes that followed, so they say at once what was seen and what is needed."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("held_out", pa.bool_()), ("cells", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (context, class) of one place

        def packed(place: int) -> pa.RecordBatch:
            context, cls = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((cls, context))
            context, cls = context[order], cls[order]
            edge = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (cls[1:] != cls[:-1])))
            n = np.diff(np.append(edge, len(cls))).astype(np.uint32)
            context, cls = context[edge], cls[edge].astype(np.uint8)
            part = (context >> np.uint64(64 - bits)).astype(np.int32)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            cells = []
            for lo, hi in zip(first, np.append(first[1:], len(part))):
                step = np.diff(context[lo:hi], prepend=np.uint64(0))
                cells.append(_planes(step) if place & 1 else _planes(step, cls[lo:hi], n[lo:hi]))
            return batch_of(schema, part[first], np.full(len(first), place >> 1), np.full(len(first), bool(place & 1)), pa.array(cells, pa.binary()))

        waiting: dict[int, list] = {}  # training and held-out texts of the chunk at hand
        chunk = None

        def done() -> Iterator[pa.RecordBatch]:
            for place, pairs in waiting.items():
                held.extend(pairs)
                yield packed(place)
            waiting.clear()

        for batch in steps(batches):
            keys, first = token_keys(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            token = np.repeat(2 * batch.column(0).to_numpy() + out, np.diff(first))
            cls = np.where(token & 1, 0, classes.of(keys))
            pairs = contexts(keys, first)
            for place in np.unique(token).tolist():
                if chunk != place >> 1 or sum(len(c) for x in waiting.values() for c, _ in x) > 2 * _HELD_TOGETHER:
                    yield from done()
                    chunk = place >> 1
                own = token == place
                waiting.setdefault(place, []).extend((context[own], cls[own]) for context in pairs)
        yield from done()

    return chunks.select("chunk", "held_out", "text").mapInArrow(pack, "part int, chunk bigint, held_out boolean, cells binary")


def seen_by_chunk(chunks: DataFrame, classes: Classes) -> DataFrame:
    """(chunk, context, seen): what ``context_needs`` finds in ``context_counts``, where it
    is held out or seen more than once, by one shuffle of packed contexts."""
    bits = max(1, int(2 * chunks.select("chunk").distinct().count()).bit_length())  # a part is less than half a chunk
    schema = pa.schema([("chunk", pa.int64()), ("context", pa.int64()), ("seen", pa.list_(pa.int64()))])

    def answer(rows: list[tuple[int, bool, pa.Buffer]]) -> Iterator[pa.RecordBatch]:
        counted, needs = [], []
        for chunk, out, cells in rows:
            data = np.frombuffer(cells, np.uint8)
            step, *rest = _from_planes(data, np.uint64) if out else _from_planes(data, np.uint64, np.uint8, np.uint32)
            context = np.cumsum(step, dtype=np.uint64)
            if not out:
                counted.append((context, *rest))
            needs.append((chunk, out, context[np.flatnonzero(np.append(True, context[1:] != context[:-1]))]))
        if not counted:
            return
        context, cls, n = (np.concatenate(x) for x in zip(*counted))
        order = np.lexsort((cls, context))
        context, cls, n = context[order], cls[order].astype(np.int64), n[order].astype(np.int64)
        edge = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (cls[1:] != cls[:-1])))
        context, seen = context[edge], np.add.reduceat(n, edge)
        packed = (seen << BITS) + cls[edge]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        size, total = np.diff(np.append(first, len(context))), np.add.reduceat(seen, first)
        context = context[first]
        for chunk, out, need in needs:
            at = np.minimum(np.searchsorted(context, need), len(context) - 1)
            at = at[(context[at] == need) & (out | (total[at] > 1))]
            for lo in range(0, len(at), 100_000):
                own = at[lo:lo + 100_000]
                start = np.concatenate([[0], np.cumsum(size[own])])
                values = packed[np.repeat(first[own] - start[:-1], size[own]) + np.arange(start[-1])]
                yield batch_of(schema, np.full(len(own), chunk), context[own].view(np.int64),
                               pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, chunk, out, cells in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                parts.setdefault(part, []).append((chunk, out, cells.as_buffer()))
        for part in sorted(parts):
            yield from answer(parts.pop(part))

    return (chunk_contexts(chunks, classes, bits).repartition(1 << bits, "part")
            .mapInArrow(run, "chunk bigint, context bigint, seen array<bigint>"))


class Seen:
    """What followed the contexts of a chunk, from rows (chunk, context, seen)."""

    def __init__(self, table: pa.Table):
        lists = table.column("seen").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        start, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        self.contexts, row = np.unique(table.column("context").to_numpy().view(np.uint64), return_index=True)
        size = (start[1:] - start[:-1])[row].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        packed = flat[np.repeat(start[:-1][row] - self.first[:-1], size) + np.arange(self.first[-1])]
        entry = np.repeat(np.arange(len(row)) << BITS, size) + (packed & ((1 << BITS) - 1))
        order = np.argsort(entry)
        self.entry, self.upto = entry[order], np.concatenate([[0], np.cumsum(packed[order] >> BITS)])

    def passed(self, context: np.ndarray, cls: np.ndarray, training: np.ndarray) -> np.ndarray:
        """(BITS + 1, tokens): how often the context was seen, and then each further
        place on the way to the class.  A context without a row was seen once,
        before this token, if the token is of a training text, else never."""
        out = np.repeat(training[None].astype(np.int64), BITS + 1, axis=0)
        if not len(self.contexts):
            return out
        order = np.argsort(context)
        at = np.searchsorted(self.contexts, context[order])
        there = self.contexts[np.minimum(at, len(self.contexts) - 1)] == context[order]
        token, at = order[there], at[there]
        lo, hi = self.first[at], self.first[at + 1]
        out[0, token] = self.upto[hi] - self.upto[lo]
        for level in range(BITS):
            half = 1 << (BITS - 1 - level)
            c = cls[token]
            middle = np.searchsorted(self.entry, (at << BITS) + (c & ~(2 * half - 1)) + half)
            right = (c & half) > 0
            lo, hi = np.where(right, middle, lo), np.where(right, hi, middle)
            out[level + 1, token] = self.upto[hi] - self.upto[lo]
        return out

    def logits(self, context: np.ndarray, cls: np.ndarray, training: np.ndarray, leave_one_out: bool) -> np.ndarray:
        """(tokens, BITS): the log-odds of bit 1 of each decision."""
        n = self.passed(context, cls, training).astype(np.float32)
        if leave_one_out:  # the counts include this very token: take it out
            n -= 1
        came = np.log(n[1:] + np.float32(0.4)) - np.log(n[:-1] - n[1:] + np.float32(0.4))
        return came.T * _SIGN[cls]


def beside(chunks: DataFrame, seen: DataFrame, run: Callable[[pa.Table, Seen], Iterator[pa.RecordBatch]],
           schema: str, known: Callable[[pa.Table], object] = Seen) -> DataFrame:
    """``run`` of every chunk's texts and of what was seen after its contexts."""

    def both(texts: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(texts):
            return empty
        return pa.Table.from_batches(run(texts.sort_by("uid"), known(rows)))

    names = T.StructType.fromDDL(schema)
    empty = pa.table({f.name: pa.array([], t) for f, t in zip(names, to_arrow_schema(names).types)})
    return chunks.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(both, schema)


# --- cells: a context and the class that followed --------------------------------------

def part_bits(tokens: int) -> int:
    """Cells are dealt by their first bits to parts of about ``PART_TOKENS``."""
    return min(MOST_PART_BITS, max(2, 1 + (tokens // PART_TOKENS).bit_length()))


class Chunk:
    """A row of ``coded`` with the cells of its tokens.

    A cell is a 64-bit number: the part (its first bit: after two words), then the
    context, then the class.  A context of words of the head is spelled by their ranks
    (the part gives the last bits of the second), any other by a hash of 54 bits, part
    included."""

    def __init__(self, row: dict, vocab: Vocabulary, bits: int):
        self.row, self.bits = row, bits
        self.first = np.concatenate([[0], np.cumsum(row["n_tokens"].to_numpy())])
        self.held_out = row["held_out"].to_numpy(zero_copy_only=False)
        self.words = _dictionary(row)
        self.at = _from_planes(_opened(row["token"], 4 * row["tokens"]), np.uint32)[0].astype(np.int64)
        self.place = vocab.places(self.words)
        self.cls = vocab.classes.of(self.words)[self.at]
        word, start = np.append(self.words, START), len(self.words)
        rank = np.append(np.where(self.place >= 0, vocab.rank[self.place] + 1 if len(vocab.keys) else 0, -1), 0)
        rank[rank >= NO_WORD] = -1
        one = np.empty_like(self.at)
        one[1:] = self.at[:-1]
        one[self.first[:-1]] = start
        two = np.empty_like(one)
        two[1:] = one[:-1]
        two[self.first[:-1]] = start
        spread = textvec.mix64(np.maximum(rank, 0).astype(np.uint64)).view(np.int64)
        after_one = self.contexts(rank, spread, np.full(start + 1, NO_WORD), (word,))
        self.after_two = self.contexts(rank.take(one), spread.take(one), rank.take(two), (word, two), (word, one))
        found = [self._distinct(c | self.cls.astype(np.uint64)) for c in (after_one.take(one), self.after_two)]
        self.cells = np.concatenate([cells for cells, _ in found])
        self.cell = found[0][1], found[1][1] + np.int32(len(found[0][0]))  # of each token after one word, after two

    def own(self) -> np.ndarray:
        """How many training tokens have each cell."""
        training = np.repeat(~self.held_out, np.diff(self.first))
        n = sum(np.bincount(cell[training], minlength=len(self.cells)) for cell in self.cell)
        return n.astype(np.uint32)

    @staticmethod
    def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different cells, and where each token's is."""
        order = np.argsort(cells)
        cells = cells.take(order)
        new = np.append(True, cells[1:] != cells[:-1])
        at = np.empty(len(cells), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        return cells[new], at

    def contexts(self, lead: np.ndarray, spread: np.ndarray, second: np.ndarray, *words: tuple) -> np.ndarray:
        bits = self.bits - 1
        out = ((spread + second) & ((1 << bits) - 1)) << (63 - bits)
        out |= (lead << (RANK_BITS - bits + BITS)) | ((second >> bits) << BITS)
        out = out.view(np.uint64)
        rare = np.flatnonzero((lead < 0) | (second < 0))
        hashed = textvec.combine(*(w[0][w[1][rare]] if len(w) > 1 else w[0][rare] for w in words))
        part, rest = hashed >> np.uint64(64 - bits), (hashed >> np.uint64(10)) & np.uint64((1 << (54 - bits)) - 1)
        out[rare] = (part << np.uint64(63 - bits)) | np.uint64(1 << (62 - bits)) | (rest << np.uint64(BITS))
        return out | np.uint64(1 << 63) if len(words) > 1 else out

    def logits(self, answers: list[dict], leave_one_out: bool) -> np.ndarray:
        """(cells, BITS): the log-odds of bit 1 of each decision on the way to each cell's
        class, from the answers of all parts."""
        out = np.empty((len(self.cells), BITS), np.float32)
        told, lo, hi = [], 0, 0
        for a in sorted(answers, key=lambda a: a["part"]):
            data, size = _opened(a["counts"], a["size"]), (BITS + 1) * a["cells"]
            sides = data[:size].astype(np.float32)
            sides[np.flatnonzero(data[:size] == LARGE)] = data[size:].view(np.uint64)
            told.append(sides.reshape(BITS + 1, -1))
            hi += a["cells"]
            if hi - lo > 1 << 15 or hi == len(self.cells):
                self._logits(self.cells[lo:hi], np.concatenate(told, axis=1), leave_one_out, out[lo:hi])
                told, lo = [], hi
        return out

    @staticmethod
    def _logits(cells: np.ndarray, sides: np.ndarray, leave_one_out: bool, out: np.ndarray) -> None:
        agree = _agreeing(cells)
        kin = np.flatnonzero((agree >= 0) | np.append(agree[1:] >= 0, False))  # of contexts with several cells
        agree, number = agree[kin], np.arange(len(kin))
        n = sides[BITS]
        odds, cls = np.empty((BITS, len(n)), np.float32), (cells & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        for k in reversed(range(BITS)):
            side, told = sides[k], np.flatnonzero(agree == k)
            some = side[kin]
            some[told] = n[kin[told] - 1]  # where the cell before went on
            side[kin] = some[np.maximum.accumulate(np.where(agree > k, 0, number))]
            # counts include this very token, which learning takes out
            came = np.maximum(n - 1, 0) if leave_one_out else n
            np.log(came + np.float32(0.4), out=odds[k])
            odds[k] -= np.log(side + np.float32(0.4))
            odds[k] *= np.ascontiguousarray(_SIGN[:, k]).take(cls)
            n += side
        out[:] = odds.T

    def groups(self, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """The marked texts in steps: their numbers, tokens, where each starts, matches, bytes."""
        texts = np.flatnonzero(texts)
        upto = np.concatenate([[0], np.cumsum(self.row["n_bytes"].to_numpy()[texts])])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + STEP_BYTES, side="right")) - 1)
            own = texts[lo:hi]
            n = self.first[own + 1] - self.first[own]
            first = np.concatenate([[0], np.cumsum(n)])
            t = np.repeat(self.first[own] - first[:-1], n) + np.arange(first[-1])
            yield own, t, first, matches(self.cls[t], self.after_two[t], first), int(upto[hi] - upto[lo])
            lo = hi


def _agreeing(cells: np.ndarray) -> np.ndarray:
    """How many decisions each cell shares with the one before, -1 after another context."""
    differ = np.append(np.uint64(1 << BITS), cells[1:] ^ cells[:-1])
    return np.where(differ < 1 << BITS, _AGREE.take(np.minimum(differ, (1 << BITS) - 1).astype(np.int64)), -1)


def cell_counts(chunks: DataFrame, vocab: Broadcast, bits: int) -> DataFrame:
    """(chunk, part, cells, size, counts): what the training texts say of each chunk's cells,
    in their order.  One shuffle of packed cells: they say at once what was seen and
    what is asked.  ``counts`` are how often each cell's way was left at each decision, and
    how often its class was seen: bytes, those of ``LARGE`` in full at the end.  What
    a cell shares with the one before is told once."""
    asked = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("cells", pa.int64()), ("cell", pa.binary())])
    told = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("cells", pa.int64()), ("size", pa.int64()), ("counts", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in drained(batches):
            for row in _rows(batch):
                chunk = Chunk(row, vocab.value, bits)
                edge = np.searchsorted(chunk.cells, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                edge = np.append(edge, len(chunk.cells))
                parts = np.flatnonzero(np.diff(edge))
                cells, own = chunk.cells & np.uint64((1 << (64 - bits)) - 1), chunk.own()
                yield batch_of(asked, parts.astype(np.int32), np.full(len(parts), row["chunk"]), np.diff(edge)[parts], pa.array(
                    [_shut(_planes(np.diff(cells[lo:hi], prepend=np.uint64(0)), own[lo:hi])) for lo, hi in zip(edge[parts], edge[parts + 1])], pa.binary()))

    def tell(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        pairs = [_from_planes(_opened(r["cell"], 12 * r["cells"]), np.uint64, np.uint32) for r in rows]
        asked_for = np.concatenate([np.cumsum(step, dtype=np.uint64) for step, _ in pairs])
        order = np.argsort(asked_for)
        cells = asked_for[order]
        new = np.append(True, cells[1:] != cells[:-1])
        row = np.empty(len(cells), np.int64)
        row[order] = np.cumsum(new) - 1
        edge = np.flatnonzero(new)
        cells = cells[edge]
        n = np.add.reduceat(np.concatenate([n for _, n in pairs])[order], edge, dtype=np.int64)
        least, more = np.empty((BITS + 1, len(n)), np.uint8), {}

        def keep(level: int, side: np.ndarray) -> None:
            least[level] = np.minimum(side, LARGE)
            more[level] = np.flatnonzero(side >= LARGE), side[side >= LARGE]

        keep(BITS, n)
        below = n
        for level in reversed(range(BITS)):  # all that goes on like this cell up to this decision
            prefix = cells >> np.uint64(BITS - level)
            edge = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            here = np.repeat(np.add.reduceat(n, edge), np.diff(np.append(edge, len(n))))
            keep(level, here - below)
            below = here
        least = least.take(row, axis=1)
        starts = np.concatenate([[0], np.cumsum([len(own) for _, own in pairs])])
        agree = _agreeing(asked_for)
        agree[starts[:-1]] = -1
        for level in range(BITS):
            least[level][agree >= level] = 0
        for r, lo, hi in zip(rows, starts, starts[1:]):
            mine = least[:, lo:hi]
            level, at = np.nonzero(mine == LARGE)
            large = [more[k][1][np.searchsorted(more[k][0], row[lo + at[level == k]])] for k in np.unique(level).tolist()]
            counts = mine.tobytes() + b"".join(x.astype(np.uint64).tobytes() for x in large)
            yield batch_of(told, [r["chunk"]], [part], [hi - lo], [len(counts)], pa.array([_shut(counts)], pa.binary()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in drained(batches):
            for row in _rows(batch):
                parts.setdefault(row["part"], []).append(row)
        for part in sorted(parts):
            yield from tell(part, parts.pop(part))

    return (chunks.mapInArrow(ask, "part int, chunk bigint, cells bigint, cell binary").repartition(1 << bits, "part")
            .mapInArrow(answer, "chunk bigint, part int, cells bigint, size bigint, counts binary"))


# --- mixing ---------------------------------------------------------------------------

class After:
    """Log-odds of tokens, kept by cell: rows are taken as a block asks for them."""

    def __init__(self, odds: np.ndarray, cell: np.ndarray):
        self.odds, self.cell = odds, cell

    def __getitem__(self, t: np.ndarray) -> np.ndarray:
        return self.odds.take(self.cell.take(t), axis=0)



class Mixer:
    """Scores texts; the weights of each text adapt block by block.  ``tree`` are the
    class tree's counts, the log-odds ``after`` the contexts are given with the texts."""

    def __init__(self, tree: np.ndarray, weights: np.ndarray):
        self.weights = weights
        placed = tree[:, _NODE]
        self.plain = (np.log(placed[1] + 0.4) - np.log(placed[0] + 0.4)).astype(np.float32)  # (classes, BITS)

    def run(self, cls: np.ndarray, match: np.ndarray, first: np.ndarray,
            after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text's classes, and the final weights of each."""
        n = len(first) - 1
        score = np.zeros(n)
        weights = np.repeat(self.weights[None], n, axis=0)
        for lo in range(0, n, GROUP_DOCS):
            hi = min(n, lo + GROUP_DOCS)
            length = np.diff(first[lo:hi + 1])
            for block in range(-(-int(length.max()) // BLOCK_TOKENS)):
                live = np.flatnonzero(length > block * BLOCK_TOKENS)
                here = np.minimum(length[live] - block * BLOCK_TOKENS, BLOCK_TOKENS)
                start = first[lo + live] + block * BLOCK_TOKENS
                ends = np.cumsum(here)
                t = np.repeat(start - ends + here, here) + np.arange(int(ends[-1]))
                text = np.repeat(lo + live, here)
                guessed = match[t] >= 0
                cost = np.empty(len(t))
                rows, marked = np.flatnonzero(~guessed), np.flatnonzero(guessed)
                if len(rows):
                    cost[rows] = self.unmatched(cls[t[rows]], self.inputs(t[rows], cls, after), text[rows], weights)
                if len(marked):
                    m = t[marked]
                    cost[marked] = self.matched(cls[m], self.inputs(m, cls, after), match[m], text[marked], weights)
                score[lo + live] += np.add.reduceat(cost, ends - here)
        return score / np.log(10), weights

    def inputs(self, t: np.ndarray, cls: np.ndarray, after: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        return [self.plain.take(cls[t], axis=0), after[0][t], after[1][t]]

    def unmatched(self, cls, x, text, weights) -> np.ndarray:
        """Log probabilities of tokens without a match; adapts their gate's weights."""
        edge = np.flatnonzero(np.diff(text, prepend=-1))
        texts, here = text[edge], np.diff(np.append(edge, len(text)))
        own = weights[texts, :, 0, :PREDICTORS - 1]  # (texts, BITS, predictors)
        z = np.repeat(own[..., 0], here, axis=0) * x[0]
        for i in range(1, PREDICTORS - 1):
            z += np.repeat(own[..., i], here, axis=0) * x[i]
        err, cost = _outcome(z, cls)
        for i in range(PREDICTORS - 1):
            gradient = np.add.reduceat(err * x[i], edge, axis=0)
            weights[texts, :, 0, i] += RATE * gradient / (here[:, None] + np.float32(8))
        return cost

    def matched(self, cls, x, match, text, weights) -> np.ndarray:
        """Log probabilities of tokens with a match; adapts the weights of its two gates."""
        agree = _LEVEL <= _AGREE[cls ^ match][:, None]
        x = [*x, np.where(agree, _SIGN[match] * np.float32(MATCH_LOGIT), np.float32(0))]
        cell = (text[:, None] * BITS + _LEVEL) * GATES + np.where(agree, 1, 2)
        flat = weights.reshape(-1, PREDICTORS)
        w = flat[cell]
        z = sum(w[..., i] * x[i] for i in range(PREDICTORS))
        err, cost = _outcome(z, cls)
        lead = int(cell.min())
        at = cell.ravel() - lead
        seen = np.bincount(at)
        for i in range(PREDICTORS):
            flat[lead:lead + len(seen), i] += RATE * np.bincount(at, weights=(err * x[i]).ravel()) / (seen + 8.0)
        return cost


def _outcome(z: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bit - p of every decision, and the log probability of every token."""
    sign = _SIGN[cls]
    odds = np.exp(-np.clip(z, -10, 10) * sign)  # of the bit that did not come; eight stay within float32
    whole = odds + np.float32(1)
    cost = -np.log(whole.prod(axis=1, dtype=np.float64))
    odds /= whole
    odds *= sign
    return odds, cost


def neutral() -> np.ndarray:
    w = np.zeros((BITS, GATES, PREDICTORS), np.float32)
    w[..., 0], w[..., 1], w[..., 2], w[..., 3] = 0.6, 0.3, 0.1, 0.3
    return w


def _prepared(column: pa.Array, classes: Classes):
    keys, first = token_keys(column)
    cls = classes.of(keys)
    one, two = contexts(keys, first)
    return keys, first, cls, one, two, matches(cls, two, first)


def learned_weights(chunks: DataFrame, counts: DataFrame, vocab: Broadcast, bits: int, tree: np.ndarray) -> np.ndarray:
    """Weights after an online pass of every task over its chunks' training
    texts, averaged by tokens.  A task's weights move once they have seen about a
    step of text, however it is dealt to chunks."""
    cells = BITS * GATES * PREDICTORS
    schema = pa.schema([("cell", pa.int64()), ("weight", pa.float64()), ("tokens", pa.int64())])
    task: dict = {}  # goes on from chunk to chunk

    def learn(texts: pa.Table, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        if not task:
            task.update(mixer=Mixer(tree, neutral()), sum=0.0, tokens=0, size=0)
        mixer, tokens, mean = task["mixer"], 0, task["mixer"].weights
        for row in _rows(texts):
            chunk = Chunk(row, vocab.value, bits)
            odds = chunk.logits(answers, True)
            one, two = chunk.cell
            for _, t, first, match, size in chunk.groups(~chunk.held_out):
                _, own = mixer.run(chunk.cls[t], match, first, (After(odds, one[t]), After(odds, two[t])))
                n = np.diff(first)
                tokens += int(n.sum())
                task["sum"] += np.tensordot(n.astype(float), own, axes=1)
                task["tokens"] += int(n.sum())
                task["size"] += size
                mean = (task["sum"] / task["tokens"]).astype(np.float32)
                if 2 * task["size"] >= STEP_BYTES:
                    mixer.weights = mean
                    task.update(sum=0.0, tokens=0, size=0)
        yield batch_of(schema, np.arange(cells), mean.reshape(-1).astype(float), np.full(cells, tokens))

    rounds = [stored(beside(*own, learn, "cell bigint, weight double, tokens bigint", lambda t: list(_rows(t))).groupBy("cell")
                     .agg(F.sum(F.col("weight") * F.col("tokens")).alias("w"), F.sum("tokens").alias("tokens")), "lm-weights")
              for own in in_rounds(chunks, counts)]
    out, total = np.zeros(cells), np.zeros(cells)
    for r in (r for table in rounds for r in table.collect()):  # a hundred rows each
        out[r["cell"]] += r["w"]
        total[r["cell"]] += r["tokens"]
    out = np.where(total > 0, out / np.maximum(total, 1), neutral().reshape(-1))
    return out.astype(np.float32).reshape(BITS, GATES, PREDICTORS)


# --- scoring ----------------------------------------------------------------------------

def _shuffles_freed(table: DataFrame) -> None:
    """Spark deletes shuffle files once the driver's garbage collector has found that
    nothing reads them any more, which a driver with little to do may not see for the
    whole job.  The scheduler holds on to the last job, so a look into ``table`` goes first."""
    table.limit(1).count()
    table.sparkSession.sparkContext._jvm.System.gc()


def in_rounds(chunks: DataFrame, counts: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Both tables in ``ROUNDS`` shares of the chunks, one after the other: only one share's
    shuffle files are on disk at a time."""
    for i in range(ROUNDS):
        own = F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == i
        yield chunks.filter(own), counts.filter(own)
        _shuffles_freed(counts)


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1, head_words: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities) and bits_per_byte of the model."""
    spark = docs.sparkSession
    workers_find_package(spark)
    rows = docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), text_bytes().alias("text"))
    chunks = stored(coded(rows), "lm-chunks")
    counts = stored(word_counts(chunks), "lm-words")
    vocab = vocabulary(counts, head_words)
    tree = tree_counts(vocab.class_n)
    bits = part_bits(chunks.agg(F.sum("tokens")).first()[0] or 0)
    shared = spark.sparkContext.broadcast(vocab)
    chunks = chunks.drop("n")
    _shuffles_freed(counts)
    cells = stored(cell_counts(chunks, shared, bits), "lm-cells")
    _shuffles_freed(cells)
    weights = learned_weights(chunks, cells, shared, bits, tree)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = (f"doc_id {id_type}, held_out boolean, uid bigint, n_bytes bigint, n_tokens bigint, n_head bigint, "
               "head_log double, class_log double, mixed_log double, tail array<bigint>")

    def run(texts: pa.Table, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        mixer = Mixer(tree, weights)
        for row in _rows(texts):
            chunk = Chunk(row, vocab, bits)
            odds = chunk.logits(answers, False)
            one, two = chunk.cell
            known = chunk.place >= 0
            logs = np.where(known, vocab.logs[chunk.place] if len(vocab.keys) else 0.0, 0.0)
            for own, t, first, match, _ in chunk.groups(np.ones(len(chunk.held_out), bool)):
                cls, at = chunk.cls[t], chunk.at[t]
                mixed, _ = mixer.run(cls, match, first, (After(odds, one[t]), After(odds, two[t])))
                inside = known[at]
                tail_first = np.concatenate([[0], np.cumsum(~inside)])[first]
                tail = pa.ListArray.from_arrays(pa.array(tail_first, pa.int32()), pa.array(chunk.words[at[~inside]].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].take(pa.array(own)), pa.array(chunk.held_out[own]), pa.array(row["uid"] + own),
                     row["n_bytes"].take(pa.array(own)), pa.array(np.diff(first)),
                     pa.array(textvec.row_sums(inside.astype(np.int64), first)), pa.array(textvec.row_sums(logs[at], first)),
                     pa.array(textvec.row_sums(vocab.class_log[cls], first)), pa.array(mixed), tail],
                    names=["doc_id", "held_out", "uid", "n_bytes", "n_tokens", "n_head", "head_log", "class_log",
                           "mixed_log", "tail"])

    scored = reduce(DataFrame.union, [stored(beside(*own, run, columns, lambda t: list(_rows(t))), "lm-scored")
                                      for own in in_rounds(chunks, cells)])
    rare = (scored.select("uid", F.explode("tail").alias("key")).join(counts, "key", "left")
            .groupBy("uid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"), F.count("n").alias("n_tail")))
    base = float(np.log10(vocab.tokens + 0.5 * (vocab.words + 1)))
    count_log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    model = count_log - F.col("class_log") + F.col("mixed_log")
    return scored.drop("tail").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (count_log - F.col("n_tokens") * base).alias("base_score"), model.alias("score"),
        F.when(F.col("n_bytes") > 0, -model * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
