"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is split by the vocabulary's pre-token pattern; a pre-token's ids never
depend on its neighbours, so a text's count is the sum over its pre-tokens.
The tree's leaves are runs of ``LEAF`` pre-tokens with their characters and
tokens, every inner node holds the sums of its two children.  An edit replaces
a range of characters: the tree finds the touched leaves, the text is split
again from a little before them (a pre-token can look one run of characters
back) until a split falls on an old leaf border with the same text to come,
and only pre-tokens in between are encoded.  The new leaves replace the old ones
and the sums above them are updated.

Scale: documents are independent, so building and editing are single passes
without a shuffle; trees can be stored as one row of two arrays per document
(``build``) and edited later after an equi-join with their edits (``apply_edits``).
Encoded pre-tokens are cached per worker up to a fixed number.

Defined cases: a null or empty text has 0 tokens.  Edits are given on the
text before any of them; null edit lists mean none.  Edits out of range are
cut to the text; of overlapping ones the later loses the part that is gone.  Repeated rows are counted each; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import drained, text_bytes, workers_find_package

LEAF = 32
_CACHE = 300_000


class Counter:
    """Token counts of pre-tokens, cached.  ``path``: a rank file, one base64
    token and its rank a line; ``pattern``: what splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0  # characters looked at so far

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for piece in set(pieces).difference(known):
            known[piece] = len(self.encoding.encode_ordinary(piece))
        self.encoded += sum(map(len, pieces))
        return [known[p] for p in pieces]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """This worker's counter for a rank file."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


class TokenTree:
    """Leaves of ``LEAF`` pre-tokens and the sums above them."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.base = 1
        while self.base < self.leaves:
            self.base *= 2
        self.sums = np.zeros((2 * self.base, 2), np.int64)
        self.sums[self.base:self.base + self.leaves, 0] = chars
        self.sums[self.base:self.base + self.leaves, 1] = tokens
        level = self.base // 2
        while level:
            self.sums[level:2 * level] = self.sums[2 * level:4 * level].reshape(level, 2, 2).sum(axis=1)
            level //= 2

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        return cls(*_leaves(counter.pattern.findall(text), counter))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_rows(self) -> np.ndarray:
        return self.sums[self.base:self.base + self.leaves]

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) that holds character ``at``."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if start + self.sums[node, 0] <= at and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.base, max(self.leaves - 1, 0)), start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> TokenTree:
        """Leaves [first, last) give way to new ones.  As many new as old: only
        the sums on their paths change; else the leaf row moves up or down."""
        if len(chars) != last - first:
            rows = self.leaf_rows()
            return TokenTree([*rows[:first, 0], *chars, *rows[last:, 0]], [*rows[:first, 1], *tokens, *rows[last:, 1]])
        self.sums[self.base + first:self.base + last, 0] = chars
        self.sums[self.base + first:self.base + last, 1] = tokens
        for node in sorted({(self.base + i) >> up for i in range(first, last)
                            for up in range(1, self.base.bit_length())}, reverse=True):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
        return self


def _leaves(pieces: list[str], counter: Counter) -> tuple[list[int], list[int]]:
    tokens = counter.counts(pieces)
    return ([sum(map(len, pieces[i:i + LEAF])) for i in range(0, len(pieces), LEAF)],
            [sum(tokens[i:i + LEAF]) for i in range(0, len(pieces), LEAF)])


def edit(tree: TokenTree, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[TokenTree, str]:
    """The tree and the text after text[start:end] became ``new``."""
    after = text[:start] + new + text[end:]
    if not tree.leaves:
        return TokenTree.of(after, counter), after
    first, begin = tree.locate(start)
    # the split before the edit can change as far back as the last run of one
    # character class: start a whole leaf earlier, and at the text's start if
    # the leaf before is one run of white space or letters
    while first > 0 and (begin >= start or not _settled(text, begin, start)):
        first -= 1
        begin -= int(tree.sums[tree.base + first, 0])
    shift = len(new) - (end - start)
    rows = tree.leaf_rows()[first:, 0]
    borders = begin + np.cumsum(rows)  # ends of the old leaves, in the old text
    pieces, at, last = [], begin, tree.leaves
    least = end + shift
    for match in counter.pattern.finditer(after, begin):
        if match.start() >= least and pieces:  # from here on the old text follows
            i = bisect_left(borders, match.start() - shift)
            if i < len(borders) and borders[i] == match.start() - shift:
                last = first + i + 1
                break
        pieces.append(match.group())
        at = match.end()
    assert last < tree.leaves or at == len(after)
    return tree.replace(first, last, *_leaves(pieces, counter)), after


def _settled(text: str, begin: int, start: int) -> bool:
    """Whether a split at ``begin`` holds whatever follows ``start``: the pattern
    looks past a pre-token only within a run of white space."""
    return any(not c.isspace() for c in text[begin:min(start, begin + 4096)])


Edit = tuple[int, int, str]


def apply_all(tree: TokenTree, text: str, edits: list[Edit], counter: Counter) -> tuple[TokenTree, str]:
    """All edits, their positions given in ``text``."""
    after, shift, reach = text, 0, 0
    for start, end, new in sorted(edits):
        start = min(max(start, reach), len(text))
        end = min(max(end, start), len(text))
        tree, after = edit(tree, after, start + shift, end + shift, new, counter)
        shift += len(new) - (end - start)
        reach = end
    return tree, after


# FIXED VALUES: what counts as an e-mail address and as a long number to be redacted.
_EMAIL = re.compile(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[ ().-]{0,2}[0-9]){7,}")


def redactions(text: str) -> list[Edit]:
    """Edits that put placeholders for e-mail addresses and long numbers."""
    found = [(m.start(), m.end(), "[EMAIL]") for m in _EMAIL.finditer(text)]
    return found + [(m.start(), m.end(), "[NUMBER]") for m in _NUMBER.finditer(text)]


def build(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, chars, tokens): the leaves of each row's tree."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in drained(batches):
            rows = [TokenTree.of(t.as_py().decode("utf-8", "replace"), own).leaf_rows() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[:, i].tolist() for r in rows], pa.list_(pa.int64())) for i in (0, 1)]],
                names=["doc_id", "chars", "tokens"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, chars array<bigint>, tokens array<bigint>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, chars, tokens, text): the documents that have ``edits``
    (doc_id, edits array<struct<start, end, new>>, one row each) after them, with
    their new trees.  ``trees`` are ``build``'s rows of the same documents."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        trees.select("doc_id", "chars", "tokens"), "doc_id").join(edits.select("doc_id", "edits"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in drained(batches):
            out = []
            for row in batch.to_pylist():
                changes = [(e["start"], e["end"], e["new"] or "") for e in row["edits"] or []]
                tree, text = apply_all(TokenTree(row["chars"], row["tokens"]), row["text"], changes, own)
                leaves = tree.leaf_rows()
                out.append((tree.tokens, leaves[:, 0].tolist(), leaves[:, 1].tolist(), text))
            lists = pa.list_(pa.int64())
            kinds = [pa.int64(), lists, lists, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in out], kinds[i]) for i in range(4)]],
                names=["doc_id", "n_tokens", "chars", "tokens", "text"])

    return joined.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, chars array<bigint>, tokens array<bigint>, text string")


def edited_counts(docs: DataFrame, path: str, pattern: str,
                  find_edits: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after,
    encoded_chars): counts before and after each text's edits; ``encoded_chars``
    is what the edits made necessary to encode again."""
    workers_find_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in drained(batches):
            rows = []
            for value in batch.column(1):
                text = value.as_py().decode("utf-8", "replace")
                tree = TokenTree.of(text, own)
                before, edits, seen = tree.tokens, find_edits(text), own.encoded
                tree, after = apply_all(tree, text, edits, own)
                rows.append((len(text), before, len(edits), len(after), tree.tokens, own.encoded - seen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]],
                names=["doc_id", *names])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))
