"""Hierarchical multi-length packing of documents into training sequences.

Tiers are powers of two (4096, 2048, ... ``TIERS[-1]``).  A document's full
windows become sequences of the largest tier at once; its remainder is routed
to the smallest tier that holds it.  Each tier is packed from the longest
down: a remainder opens a window, the gap is filled with the longest
remainders of shorter tiers that fit, and one last piece is cut to close it
exactly.  Windows of a tier are then dealt to step groups of ``step_tokens``
tokens so that the groups of a tier carry about the same attention cost (sum
of squared piece lengths).  What is left at the end of a partition becomes
windows of ever shorter tiers and one padded sequence.

Scale: one pass without a shuffle.  A task packs pools of about ``pool_tokens``
tokens, so memory is bounded by a pool and the longest document; sequences
never span input partitions, which costs at most one padded sequence for each.
Sequence ids are (partition, running number), so a repeated task gives the
same ids.

Defined cases: a null or empty text has only the end token.  Null, repeated
or tied doc_ids are packed row by row.  An empty table gives an empty result.
Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import steps, text_bytes, workers_find_package
from claimspark.llm.word_tokens import encoder

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2

Piece = tuple[int, int, int]  # length, document number, start


class Packer:
    """Packs one partition; feed it documents, take finished sequences."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, pool_tokens: int = 1 << 21):
        self.tiers, self.pool_tokens = tiers, pool_tokens
        self.step_size = {t: max(1, step_tokens // t) for t in tiers}
        self.loose: list[Piece] = []  # remainders, sorted by length
        self.pooled = 0
        self.ready: dict[int, list[list[Piece]]] = {t: [] for t in tiers}
        self.out: list[tuple[int, int, list[Piece]]] = []  # (tier, step group, pieces)
        self.groups = 0

    def add(self, document: int, tokens: int) -> None:
        top = self.tiers[0]
        for start in range(0, tokens - tokens % top, top):
            self.ready[top].append([(top, document, start)])
        if tokens % top:
            insort(self.loose, (tokens % top, document, tokens - tokens % top))
            self.pooled += tokens % top
        if self.pooled >= self.pool_tokens:
            self.pack()

    def tier_of(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if t >= length)

    def pack(self) -> None:
        """Close windows while the pool can fill them."""
        while self.loose:
            tier = self.tier_of(self.loose[-1][0])
            if self.pooled < tier:
                break
            self.ready[tier].append(self.window(tier))
        self.deal()

    def window(self, tier: int) -> list[Piece]:
        pieces, gap = [], tier
        while gap:
            at = bisect_right(self.loose, (gap, 1 << 62, 0)) - 1
            if at >= 0:  # the longest that fits
                piece = self.loose.pop(at)
            else:  # none fits: cut the shortest
                length, document, start = self.loose.pop(bisect_left(self.loose, (gap, 0, 0)))
                piece = (gap, document, start)
                insort(self.loose, (length - gap, document, start + gap))
            pieces.append(piece)
            gap -= piece[0]
            self.pooled -= piece[0]
        return pieces

    def deal(self, last: bool = False) -> None:
        """Deal full step groups, costliest windows first, back and forth."""
        for tier, windows in self.ready.items():
            size = self.step_size[tier]
            groups = -(-len(windows) // size) if last else len(windows) // size
            if not groups:
                continue
            windows.sort(key=lambda w: -sum(p[0] ** 2 for p in w))
            take = windows[:groups * size]
            self.ready[tier] = windows[groups * size:]
            for i, window in enumerate(take):
                lap, lane = divmod(i, groups)
                self.out.append((tier, self.groups + (lane if lap % 2 == 0 else groups - 1 - lane), window))
            self.groups += groups

    def finish(self) -> None:
        self.pack()
        while self.pooled >= self.tiers[-1]:
            tier = next(t for t in self.tiers if t <= self.pooled)
            self.ready[tier].append(self.window(tier))
        self.deal(last=True)
        if self.loose:
            self.out.append((self.tiers[0], self.groups, list(self.loose)))
            self.loose, self.pooled = [], 0


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
COLUMNS = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
           "sequence_id bigint, offset bigint, tier int, step_group bigint")


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16,
         pool_tokens: int = 1 << 21, cache_words: int = 600_000) -> DataFrame:
    """One row per piece: where it comes from, where it goes, its ids' CRC-32.

    ``tokenizer`` is the path of a vocabulary file of the tokenizers library;
    every document ends with ``END_ID``.  A sequence of ``tier`` tokens that its
    pieces do not fill is padded; ``step_group`` numbers the step it belongs to.
    ``cache_words`` sizes each worker's cache of encoded words.
    """
    workers_find_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache_words).encode
        packer = Packer(tiers, step_tokens, pool_tokens)
        owner: dict[int, tuple[int | None, np.ndarray]] = {}
        base = TaskContext.get().partitionId() << 33
        number = sequences = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            rows = []
            for tier, group, pieces in packer.out:
                offset = 0
                for length, document, start in pieces:
                    doc_id, ids = owner[document]
                    crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
                    rows.append((doc_id, start, length, crc, len(ids), base + sequences, offset, tier, base + group))
                    offset += length
                sequences += 1
            packer.out = []
            held = {d for _, d, _ in packer.loose} | {d for ws in packer.ready.values() for w in ws for _, d, _ in w}
            for document in list(owner):
                if document not in held:
                    del owner[document]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 50_000]), SCHEMA)], schema=SCHEMA)

        for batch in steps(batches):
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.append(ids, np.uint32(END_ID))
                owner[number] = (doc_id, ids)
                packer.add(number, len(ids))
                number += 1
            if packer.out:
                yield from emit()
        packer.finish()
        yield from emit()

    return rows.mapInArrow(run, COLUMNS)
