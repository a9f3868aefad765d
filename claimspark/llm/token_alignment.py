"""Alignment of the tokens of two tokenizers over the same bytes.

A text (with a space before it) is cut into tokens by a byte-level BPE file of
the tokenizers library (A) and by a sentencepiece model (B).  Where tokens of
both end at the same byte, a group ends; the last tokens of a group are linked.

Diagonal run skipping.  The end offsets of A's and B's tokens are two rising
arrays.  At the current shift between their indices, exponential probing
compares ever longer slices of both; a slice that differs is halved until the
stretch of one-to-one groups is measured, and jumped.  After it an irregular
group is resolved locally, the side that lags going on until both ends agree,
which gives the next shift.

Tokens.  Neither vocabulary joins what stands on both sides of a space or line
feed after a character that is no white space (checked for B when it is
loaded), so a text's ids are the ids of such units in order.  Units are encoded
many at a time and kept in a bounded cache.

Counts.  How often an id pair is linked in the corpus: each text's different
pairs with their numbers are written once, summed in the tasks and then by
Spark.  The ``head_pairs`` most frequent pairs are broadcast (a fixed size), the
links of all others are joined with the table of counts.

Scale: texts are read and tokenized once and never shuffled; a task works on
blocks of ``BLOCK_UNITS`` units, so memory is bounded by one block and the
longest text itself.  A group's end is where a unit ends, so a long text is
cut between units without changing anything.

Defined cases: a null or empty text, one that is not valid UTF-8 and one whose
joined A or B bytes differ from the space and the text have no tokens: zeros and
an empty digest, and nothing of them is counted.  No token of either vocabulary is
empty, so a group has exactly one link.  Null, repeated or tied doc_ids are
aligned row by row.  An empty table gives an empty result.  Only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimspark.llm.common import batch_of, steps, stored, text_bytes, workers_find_package

#: A unit starts with a space or line feed after a character that is no white space.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*(?:\s+\Z)?|\s+\Z")
#: The same for a vocabulary's pieces: none may hold the start of a unit inside.
_INSIDE = re.compile(r"\S[ \n]")
BLOCK_UNITS = 1 << 17
_JOINED = 400
_FIRST = " x"


# --- alignment -----------------------------------------------------------------------

def aligned(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of A's and B's last token of every group.  Both lists rise and
    have the same last element."""
    n, m = len(ends_a), len(ends_b)
    at, shifts, length = [], [], []
    i = shift = 0
    while i < n:
        # an irregular group: the side that lags goes on
        j = i + shift
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        shift = j - i
        first, most = i, min(n, m - shift)
        # one-to-one groups at this shift
        i += 1
        step = 1
        while i + step <= most and ends_a[i:i + step] == ends_b[i + shift:i + shift + step]:
            i += step
            step *= 2
        while step > 1:
            step //= 2
            if i + step <= most and ends_a[i:i + step] == ends_b[i + shift:i + shift + step]:
                i += step
        at.append(first)
        shifts.append(shift)
        length.append(i - first)
    size = np.array(length, np.int64)
    last_a = ranges(np.array(at, np.int64), size)
    return last_a, last_a + np.repeat(np.array(shifts, np.int64), size)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + size."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and where each group ends in them."""
    count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place_a = np.arange(len(ids_a)) + np.repeat(last_b + 1 - count_b, count_a)
    place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, count_b)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    top = int(ids.max(initial=0))
    power = 10
    while power <= top:
        digits += ids >= power
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    at, left = ends - 2, ids
    while len(at):
        rest = left // 10
        out[at] = left - 10 * rest + ord("0")
        more = rest > 0
        at, left = at[more] - 1, rest[more]
    return out, ends[place_b[last_b]]


# --- tokens ----------------------------------------------------------------------------

class _Ids:
    """The ids of the units of one tokenizer, one after another."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0
        self.start, self.size, self.units = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def add(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.units + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[self.units:self.units + len(size)] = start + self.used
        self.size[self.units:self.units + len(size)] = size
        self.used += len(ids)
        self.units += len(size)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.start[places], self.size[places])]


class Tokenizers:
    """Both vocabularies and the cache of units."""

    def __init__(self, path_a: str, path_b: str, cache_units: int):
        self.cache_units = cache_units
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            spelled = [alphabet.get(c) for c in token]
            self.bytes_a[number] = token.encode() if None in spelled else bytes(spelled)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.cut = not any(_INSIDE.search(p.replace("▁", " ")) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids_a, self.ids_b = _Ids(), _Ids()
        self.bad: set[int] = set()  # places of units that one vocabulary does not give back

    def units(self, text: str, most: int) -> Iterator[list[str]]:
        """The units of a space and the text, in lists of at most ``most``."""
        if not self.cut:
            yield [" " + text]
        elif len(text) <= most:
            yield UNIT.findall(" " + text)
        else:
            found = map(re.Match.group, UNIT.finditer(" " + text))
            while part := list(islice(found, most)):
                yield part

    def places_of(self, units: list[str]) -> np.ndarray:
        """Where the ids of each unit are kept."""
        out = list(map(self.places.get, units))
        if None in out:
            self._encode(list(dict.fromkeys(u for u, place in zip(units, out) if place is None)))
            return np.fromiter(map(self.places.__getitem__, units), np.int64, len(units))
        return np.array(out, np.int64)

    def _encode(self, new: list[str]) -> None:
        plain = [u for u in new if not u[-1].isspace()] if self.cut else []
        for i in range(0, len(plain), _JOINED):
            part = plain[i:i + _JOINED]
            if not self._together(part):
                for unit in part:
                    self._alone(unit)
        for unit in new:
            if unit not in self.places:
                self._alone(unit)

    def _together(self, units: list[str]) -> bool:
        whole = _FIRST + "".join(units)
        ids = self._ids_a(whole), np.array(self.b.encode(whole[1:]), np.int64)
        expected = whole.encode()
        ends = np.cumsum([len(_FIRST), *(len(u.encode()) for u in units)])
        cuts = []
        for x, table, size in zip(ids, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b)):
            if b"".join([table[i] for i in x.tolist()]) != expected:
                return False
            upto = np.cumsum(size[x])
            cut = np.searchsorted(upto, ends)
            if (upto[cut] != ends).any():
                return False
            cuts.append(cut + 1)
        for unit in units:
            self.places[unit] = len(self.places)
        for keep, x, cut in zip((self.ids_a, self.ids_b), ids, cuts):
            keep.add(x, cut[:-1], np.diff(cut))
        return True

    def _alone(self, unit: str) -> None:
        place = self.places[unit] = len(self.places)
        a = self._ids_a(unit)
        if unit.startswith(" "):
            b = self.b.encode(unit[1:])  # B adds the space itself
        else:
            b = self.b.encode(unit)
            if b[:1] == [self.space]:
                b = b[1:]
        for keep, x in ((self.ids_a, a), (self.ids_b, np.array(b, np.int64))):
            keep.add(x, np.zeros(1, np.int64), np.array([len(x)]))
        expected = unit.encode()
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != expected or b"".join([self.bytes_b[i] for i in b]) != expected:
            self.bad.add(place)

    def _ids_a(self, text: str) -> np.ndarray:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str, cache_units: int) -> Tokenizers:
    """This worker's vocabularies; the cache stays between tasks."""
    key = (path_a, path_b)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(path_a, path_b, cache_units)
    _TOKENIZERS[key].cache_units = cache_units
    return _TOKENIZERS[key]


# --- texts -------------------------------------------------------------------------------

@dataclass
class Text:
    """What is known of a text so far."""

    row: int
    n_a: int = 0
    n_b: int = 0
    groups: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    bad: bool = False

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs and their numbers."""
        if self.bad or not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.pairs[0] if len(self.pairs) == 1 else summed(self.pairs)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One entry a key from (keys, numbers)."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[:len(keys)]
    return keys[edge], np.add.reduceat(n, edge) if len(edge) else n


def align_texts(both: Tokenizers, texts: list[bytes | None], block_units: int = BLOCK_UNITS) -> list[Text]:
    """Aligns texts block by block; a block ends between units, also inside a text."""
    out = [Text(i) for i in range(len(texts))]
    units: list[str] = []
    held: list[tuple[Text, int]] = []  # texts of the block with their number of units

    def block() -> None:
        if not held:
            return
        if len(both.places) > both.cache_units:
            both.clear()
        _align_block(both, both.places_of(units), held)
        units.clear()
        held.clear()

    for text, raw in zip(out, texts):
        if not raw:
            continue
        try:
            whole = raw.decode()
        except UnicodeDecodeError:
            text.bad = True
            continue
        for part in both.units(whole, block_units):
            units += part
            held.append((text, len(part)))
            if len(units) >= block_units:
                block()
    block()
    return out


def _align_block(both: Tokenizers, places: np.ndarray, held: list[tuple[Text, int]]) -> None:
    if both.bad:
        wrong = np.isin(places, list(both.bad))
        upto = np.cumsum([0, *(n for _, n in held)])
        keep = np.ones(len(places), bool)
        for (text, _), lo, hi in zip(held, upto, upto[1:]):
            text.bad |= bool(wrong[lo:hi].any())
            if text.bad:
                keep[lo:hi] = False
        places = places[keep]
        held = [(text, n) for text, n in held if not text.bad]
    if not len(places):
        return
    a, b = both.ids_a.of(places), both.ids_b.of(places)
    last_a, last_b = aligned(np.cumsum(both.size_a[a]).tolist(), np.cumsum(both.size_b[b]).tolist())
    said, ends = spelled(a, b, last_a, last_b)
    said = said.tobytes()
    key = (a[last_a].astype(np.int64) << 32) | b[last_b]
    # the tokens and groups of each text: a unit ends a group
    of_unit = np.cumsum([n for _, n in held]) - 1
    upto_a = np.cumsum(both.ids_a.size[places])[of_unit]
    upto_b = np.cumsum(both.ids_b.size[places])[of_unit]
    upto_group = np.searchsorted(last_a, upto_a - 1) + 1
    number = np.repeat(np.arange(len(held)), np.diff(upto_group, prepend=0))
    order = np.lexsort((key, number))
    key, number = key[order], number[order]
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (number[1:] != number[:-1])))
    n = np.diff(np.append(edge, len(key)))
    first_pair = np.searchsorted(number[edge], np.arange(len(held) + 1))
    a0 = b0 = g0 = byte0 = 0
    for i, (text, _) in enumerate(held):
        g1 = int(upto_group[i])
        text.n_a, text.n_b = text.n_a + int(upto_a[i]) - a0, text.n_b + int(upto_b[i]) - b0
        if text.groups:
            text.digest.update(b";")
        text.groups += g1 - g0
        byte1 = int(ends[g1 - 1])
        text.digest.update(said[byte0:byte1 - 1])  # without the last semicolon
        mine = slice(first_pair[i], first_pair[i + 1])
        text.pairs.append((key[edge[mine]], n[mine]))
        a0, b0, g0, byte0 = int(upto_a[i]), int(upto_b[i]), g1, byte1


# --- jobs -----------------------------------------------------------------------------------

def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def alignments(docs: DataFrame, path_a: str, path_b: str, cache_units: int) -> DataFrame:
    """A row a text: its figures, and its different linked pairs (arrays a, b) with
    their numbers (array n).  ``uid`` numbers the rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.list_(pa.int32())),
                        ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b, cache_units)
        uid = TaskContext.get().partitionId() << 33
        for batch in steps(batches):
            texts = align_texts(both, batch.column(1).to_pylist())
            fine = [not t.bad and t.groups > 0 for t in texts]
            pairs = [t.summed() for t in texts]
            figures = [[getattr(t, name) if ok else 0 for t, ok in zip(texts, fine)] for name in ("n_a", "n_b", "groups")]
            yield batch_of(schema, uid + np.arange(len(texts)), batch.column(0), *figures,
                           [t.digest.hexdigest() if ok else "" for t, ok in zip(texts, fine)],
                           _lists([k >> 32 for k, _ in pairs], pa.int32()),
                           _lists([k & 0xFFFFFFFF for k, _ in pairs], pa.int32()), _lists([n for _, n in pairs], pa.int64()))
            uid += len(texts)

    return rows.mapInArrow(run, "uid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
                                "a array<int>, b array<int>, n array<bigint>")


def _flat(batch: pa.RecordBatch, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of the pairs of a batch with a, b and n from column ``a`` on."""
    x, y, n = (batch.column(a + i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
    return (x.astype(np.int64) << 32) | y, n


def pair_counts(texts: DataFrame, hold: int = 4_000_000) -> DataFrame:
    """(key, n, best): of every linked pair (A's id * 2^32 + B's id) how often it is
    linked, and whether no pair of its B id is linked more often."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(_flat(batch, 0))
            if sum(len(k) for k, _ in held) > hold:
                held = [summed(held)]
                if len(held[0][0]) > hold // 2:
                    yield batch_of(schema, *held.pop())
        if held:
            yield batch_of(schema, *summed(held))

    counts = stored(texts.select("a", "b", "n").mapInArrow(add, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")),
                    "alignment-counts")
    of_b = F.expr("key & 4294967295").alias("b")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))  # at most a row for each id of B
    return counts.select("*", of_b).join(F.broadcast(most), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, head_pairs: int) -> tuple[DataFrame, bool]:
    """At most ``head_pairs`` of the most frequent pairs, and whether these are all."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("shiftleft(1L, cast(floor(log2(n)) as int))"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()  # about a thousand rows
    room, least = head_pairs, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["level"]):
        room -= row["pairs"]
        if room < 0:
            return counts.filter(F.col("n") >= least), False
        least = row["level"]
    return counts, True


def align(docs: DataFrame, path_a: str, path_b: str, head_pairs: int = 1 << 19, cache_units: int = 300_000) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    workers_find_package(spark)
    texts = stored(alignments(docs, path_a, path_b, cache_units), "alignment-texts")
    counts = stored(pair_counts(texts), "alignment-pairs")
    head, is_all = frequent(counts, head_pairs)
    table = head.toArrow()
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(
        (keys[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number, best = shared.value
        for batch in batches:
            key, n = _flat(batch, 6)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            worth, good = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            worth[known] = n[known] * number[at[known]]
            good[known] = n[known] * best[at[known]]
            first = batch.column(6).offsets.to_numpy().astype(np.int64)
            first -= first[0]
            rest = np.concatenate([[0], np.cumsum(~known)])[first]
            sums = (np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (good, worth))
            left = (pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~known])) for x in (key, n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *map(pa.array, sums), *left], names=[
                *batch.schema.names[:6], "n_best", "count_sum", "rest", "rest_n"])

    found = texts.mapInArrow(look, "uid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
                                   "n_best bigint, count_sum bigint, rest array<bigint>, rest_n array<bigint>")
    if not is_all:
        found = stored(found, "alignment-found")
        rare = (found.select("uid", F.explode(F.arrays_zip("rest", "rest_n")).alias("p"))
                .select("uid", F.col("p.rest").alias("key"), F.col("p.rest_n").alias("times")).join(counts, "key")
                .groupBy("uid").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("more_sum")))
        found = found.join(rare, "uid", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                        "groups_sha256")
