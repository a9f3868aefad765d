"""Reducing a large table to the rows whose key another table may hold.

A blocked Bloom filter made and used with built-in expressions only: a key's hash
names a 64-bit word and ``HASHES`` bits of it.  The words of the wanted keys are
OR-ed by one aggregate into a table of at most ``max_words`` rows, which is
broadcast and looked up by word, so the rows that go on to a shuffle shrink to
those that will find a partner, and a few per cent of others.  No wanted row is
lost: the join or aggregate that follows gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.session import BROADCAST_ROWS, stored

#: Bits of a word that a key sets, and bits a key is given room for.
HASHES, BITS_A_KEY = 4, 16
#: Fewer bits a key than this let so many rows pass that the filter is left out.
LEAST_BITS = 6
MAX_WORDS = 1 << 20


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(words))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(29))
    out = F.lit(0).cast("bigint")
    for i in range(HASHES):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return out


def bloom_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(_word, _bits) of the non-null keys: at most ``words`` rows."""
    k = F.col(f"`{key}`")
    return (keys.filter(k.isNotNull()).select(_word(k, words).alias("_word"), _mask(k).alias("_bits"))
            .groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))


def reduce_by_keys(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str | None = None, unique: bool = False,
                   max_words: int = MAX_WORDS, exact_up_to: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``wanted``, and with many wanted
    keys a few others; rows with a null key go.

    The distinct wanted keys are written once and counted: up to ``exact_up_to``
    they are broadcast themselves; beyond that the Bloom filter of a power of two
    of words; where ``max_words`` leave too few bits a key, ``df`` is returned whole.
    ``unique``: ``wanted`` is a stored table with a row a key and is read as it is.
    """
    wanted_key = wanted_key or key
    keys = wanted.select(F.col(f"`{wanted_key}`").alias("_wanted")).filter("_wanted IS NOT NULL")
    keys = keys if unique else stored(keys.distinct(), "wanted-keys")
    n = keys.count()
    if n <= exact_up_to:
        return df.join(F.broadcast(keys), F.col(f"`{key}`") == F.col("_wanted"), "left_semi")
    words = 1 << max(0, (n * BITS_A_KEY // 64 - 1).bit_length())
    words = min(words, max_words)
    if words * 64 < n * LEAST_BITS:
        return df.filter(F.col(f"`{key}`").isNotNull())
    table = F.broadcast(bloom_words(keys, "_wanted", words))  # at most max_words rows
    mask = _mask(F.col(f"`{key}`"))
    met = (_word(F.col(f"`{key}`"), words) == F.col("_word")) & (F.col("_bits").bitwiseAND(mask) == mask)
    return df.filter(F.col(f"`{key}`").isNotNull()).join(table, met, "left_semi")
