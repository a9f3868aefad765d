"""Token ids of whole texts through a per-worker cache of words.

The vocabulary's pre-tokenizer drops white space and never joins what stands
on both sides of it, so the ids of a text are the ids of its ASCII
white-space-separated words in order; it lower-cases, so words are kept in lower
case.  Words are encoded once and looked up after that.  New words of printable
ASCII and Latin-1 letters are split by the same pattern in Python; what a word
is made of (letters, a digit, punctuation) is kept as well, so that only new
pieces go to the merges, many at a time.  All other new words are encoded many
at a time by the whole tokenizer, separated by a control character that is a
token of its own.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

_SEPARATOR = "\x01"
_JOINED = 400
#: Words that need no Unicode normalisation: lower-casing moves each letter alone.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# FIXED VALUE: the vocabulary's own pre-token pattern, for lower-case ASCII and Latin-1 letters.
_PIECES = re.compile(r"\x01|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s\x01a-z0-9ß-öø-ÿ]+")
#: What ends every pre-token's last token.
_WORD_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells the UTF-8 bytes of each Latin-1 letter: bytes
    that print in Latin-1 as themselves, the others as characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    spell = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_SPELLED = _byte_letters()


class WordEncoder:
    """Ids of words, with a cache of two generations of ``generation`` words."""

    def __init__(self, path: str, generation: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.generation = generation
        ids = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = ids[0] if len(ids) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.old = _Generation()
        self.now = _Generation()
        self.pieces = _Generation()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text as uint32 arrays."""
        if len(self.now.at) > self.generation:
            self.old, self.now = self.now, _Generation()
        if len(self.pieces.at) > self.generation:
            self.pieces = _Generation()
        now = self.now
        look = now.at.__getitem__
        places = []
        for text in texts:
            words = text.lower().split()  # bytes: ASCII letters and white space only
            places.append(np.fromiter(map(look, words), np.int64, len(words)))
        self._fill()
        return [_gather(now.ids, now.start[at], now.size[at]) for at in places]

    def _fill(self) -> None:
        """Ids of the words that the last texts brought."""
        new, self.now.at.new = self.now.at.new, []
        if not new:
            return
        self.now.reserve()
        first = len(self.now.at) - len(new)
        before = np.fromiter((self.old.at.get(w, -1) for w in new), np.int64, len(new))
        known = np.flatnonzero(before >= 0)
        start, size = self.old.start[before[known]], self.old.size[before[known]]
        self.now.add(first + known, _gather(self.old.ids, start, size), np.cumsum(size) - size, size)
        plain, others, single = [], [], []
        for i in np.flatnonzero(before < 0).tolist():
            word = new[i].decode("utf-8", "replace")
            if _PLAIN.fullmatch(word) and "<|" not in word:
                plain.append((i, word))
            elif self.separator is None or _SEPARATOR in word:
                single.append((i, word))
            else:
                others.append((i, word))
        if plain:
            single += self._of_pieces(first, plain)
        for j in range(0, len(others), _JOINED):
            part = others[j:j + _JOINED]
            text = f" {_SEPARATOR} ".join(w for _, w in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.separator)
            if len(cut) != len(part) - 1:  # a word has the separator's id inside
                single += part
                continue
            begin = np.append(-1, cut) + 1
            self.now.add(np.array([first + i for i, _ in part]), ids, begin, np.append(cut, len(ids)) - begin)
        for i, word in single:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
            self.now.add(np.array([first + i]), ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _of_pieces(self, first: int, words: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Ids of plain words from those of their pieces; returns the words this can't serve."""
        found = _PIECES.findall(_SEPARATOR.join(w for _, w in words).lower())
        pieces = self.pieces
        look = pieces.at.__getitem__
        at = np.fromiter(map(look, found), np.int64, len(found))
        new, pieces.at.new = pieces.at.new, []
        pieces.reserve()
        todo = sorted((p for p in new if p != _SEPARATOR), key=str.isascii)
        for j in range(0, len(todo), _JOINED):
            part = todo[j:j + _JOINED]
            text = " ".join(part)
            text = text if text.isascii() else text.translate(_SPELLED)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):  # the vocabulary does not mark its ends so
                self.pieces = _Generation()
                return words
            pieces.add(np.array([pieces.at[p] for p in part]), ids, np.append(0, ends[:-1]), np.diff(ends, prepend=0))
        mark = at == pieces.at.get(_SEPARATOR, -1)
        cut = np.flatnonzero(mark)
        size = np.where(mark, 0, pieces.size[at])
        upto = np.concatenate([[0], np.cumsum(size)])
        begin, end = upto[np.append(0, cut + 1)], upto[np.append(cut, len(at))]
        ids = _gather(pieces.ids, pieces.start[at[~mark]], pieces.size[at[~mark]])
        self.now.add(np.array([first + i for i, _ in words]), ids, begin, end - begin)
        return []


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges ids[start:start + size]."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(start - ends + size, size) + np.arange(total)]


class _Places(dict):
    """word -> place; a new word gets the next place and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word: bytes | str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class _Generation:
    def __init__(self):
        self.at = _Places()
        self.ids = np.zeros(1 << 12, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 10, np.int64)
        self.size = np.zeros(1 << 10, np.int64)

    def reserve(self) -> None:
        while len(self.start) < len(self.at):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])

    def add(self, places: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.start[places], self.size[places] = start + self.used, size
        self.used += len(ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, cache_words: int) -> WordEncoder:
    """This worker's encoder for a vocabulary file; its cache holds up to two
    times ``cache_words`` words (about 150 bytes each) between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].generation = cache_words
    return _ENCODERS[path]
