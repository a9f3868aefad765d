"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets exact counts (words, characters in words, symbols,
repeated lines, words in repeated three-word windows).  Four ratios of them
are summarised per (language, source) in DDSketches (Masson et al., VLDB 2019):
log-spaced bins with a relative error of ``ALPHA``, kept as rows (group, metric,
bin, count), so that merging is a sum which Spark pre-aggregates before the
shuffle.  A group under ``min_group`` documents borrows its language's merged
sketch, a small language the one of all documents.  The sketches hold the documents
that the fixed base rules pass.  Such a document is rejected where a ratio lies
above its group's upper quantile by more than ``reach`` times that quantile's
distance from the median (word length: below the lower one, too); ``floor`` stands in
for the distance only where the group has next to none.

Repeated windows are found by 64-bit hashes within a slice of texts; two
different windows among n of a slice share one with a probability of about
n^2 / 2^65.

Scale: the counts are one vectorised pass without a shuffle; sketches have at
most a few thousand rows a group whatever its size; the limits (one row a
group) are broadcast if there are at most ``BROADCAST_GROUPS`` of them, else
joined by a shuffle that adaptive execution splits where a group is hot.

Defined cases: null or empty text has no words and fails the base rules.  A
null language or source counts as ''.  Repeated rows are measured and returned
each.  An empty table gives an empty result.  Input columns pass through
``keep`` unchanged; the counts use reserved names, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm import textvec
from claimspark.llm.common import buffers, steps, stored, text_bytes, workers_find_package

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Values up to this share the sketch's zero bin.
TINY = 1e-6
#: Limits of up to so many groups (about 100 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_P = "__llm_"


@dataclass(frozen=True)
class Limit:
    """One ratio, the quantile its limit starts from, and how far beyond it may lie."""

    metric: str
    quantile: float
    reach: float
    floor: float
    both_sides: bool = False


#: Ratios that few documents have at all start from a higher quantile.
LIMITS = (
    Limit("symbols_per_word", 0.75, reach=8.0, floor=0.0125),
    Limit("dup_line_share", 0.95, reach=8.0, floor=0.04),
    Limit("repeat_share", 0.95, reach=8.0, floor=0.04),
    Limit("word_length", 0.75, reach=8.0, floor=0.05, both_sides=True),
)
QUANTILES = (0.25, 0.5, 0.75, 0.95)


# --- counts ---------------------------------------------------------------------

def count_slice(column: pa.Array) -> dict[str, np.ndarray]:
    """The exact counts of each text in a binary Arrow array."""
    data, offsets = buffers(column)
    words = textvec.split(data, offsets)
    n = len(column)
    chars = textvec.counted(words.inside & ((data & 0xC0) != 0x80), offsets)
    symbols = textvec.counted(_SYMBOL[data], offsets)
    repeat = np.zeros(n, np.int64)
    if len(words.start) > 2:
        key = textvec.keys(data, words)
        at = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        gram = textvec.combine(key[at], key[at + 1], key[at + 2], words.doc[at].astype(np.uint64))
        order = np.argsort(gram)
        same = gram[order][1:] == gram[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(key), bool)
        for shift in range(3):
            covered[at[twice] + shift] = True
        repeat = np.bincount(words.doc[covered], minlength=n)
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        worded = [x for x in raw[offsets[i]:offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(worded)
        dups[i] = len(worded) - len(set(worded))
    return {"n_words": np.diff(words.first), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups,
            "n_repeat_words": repeat, "n_lines": lines}


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` plus the counts under reserved names."""
    workers_find_package(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], text_bytes().alias(f"{_P}text"))
    names = [*COUNTS, "n_lines"]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(_P + c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, f"{_P}text"):
            counts = count_slice(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(counts[c].astype(np.int64)) for c in names]],
                names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def ratio(metric: str) -> Column:
    """A ratio of a measured row; only for rows with words."""
    c = {k: F.col(_P + k).cast("double") for k in [*COUNTS, "n_lines"]}
    return {"symbols_per_word": c["n_symbols"] / c["n_words"],
            "dup_line_share": c["n_dup_lines"] / c["n_lines"],
            "repeat_share": c["n_repeat_words"] / c["n_words"],
            "word_length": c["word_chars"] / c["n_words"]}[metric]


def _group() -> list[Column]:
    return [F.coalesce("lang", F.lit("")).alias(_P + "lang"), F.coalesce("source", F.lit("")).alias(_P + "source")]


# --- sketches and limits ------------------------------------------------------------

def _failed() -> Column:
    """Whether a measured row fails the base rules."""
    words, repeats = F.col(_P + "n_words"), F.col(_P + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): a DDSketch per group and ratio of the rows
    that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(r.metric).alias("metric"), ratio(r.metric).alias("value"))
                                 for r in LIMITS])).alias("v")
    bin_ = F.when(F.col("v.value") > TINY, F.ceil(F.log("v.value") / F.lit(math.log(GAMMA)))).otherwise(
        F.lit(-(1 << 31))).cast("bigint")
    return (measured.filter(~_failed()).select(*_group(), values)
            .select(F.col(_P + "lang").alias("lang"), F.col(_P + "source").alias("source"),
                    F.col("v.metric").alias("metric"), bin_.alias("bin"))
            .groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged over all groups that agree in ``keys``."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, n, q25, q50, q75, q95) of each sketch."""
    per = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(per.orderBy("bin"))).withColumn(
        "total", F.sum("n").over(per))
    value = F.when(F.col("bin") == -(1 << 31), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(GAMMA), F.col("bin").cast("double")) / (GAMMA + 1))
    return ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("n"),
        *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), value)).alias(f"q{round(100 * q)}")
          for q in QUANTILES])


def limits(sketch: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, then low and high per metric): one row for each group."""
    own = quartiles(sketch, "lang", "source").select("lang", "source", "metric", F.struct("n", *[f"q{round(100 * q)}" for q in QUANTILES]).alias("own"))
    lang = quartiles(merged(sketch, "lang"), "lang").select("lang", "metric", F.struct("n", *[f"q{round(100 * q)}" for q in QUANTILES]).alias("by_lang"))
    whole = quartiles(merged(sketch)).select("metric", F.struct("n", *[f"q{round(100 * q)}" for q in QUANTILES]).alias("overall"))
    best = (own.join(lang, ["lang", "metric"]).join(whole, "metric")
            .withColumn("q", F.when(F.col("own.n") >= min_group, F.col("own"))
                        .when(F.col("by_lang.n") >= min_group, F.col("by_lang")).otherwise(F.col("overall"))))
    aggs = []
    for r in LIMITS:
        middle, upper, lower = F.col("q.q50"), F.col(f"q.q{round(100 * r.quantile)}"), F.col("q.q25")
        high = upper + r.reach * F.greatest(upper - middle, F.lit(r.floor))
        low = lower - r.reach * F.greatest(middle - lower, F.lit(r.floor))
        mine = F.col("metric") == r.metric
        aggs.append(F.max(F.when(mine, high)).alias(f"{_P}high_{r.metric}"))
        if r.both_sides:
            aggs.append(F.max(F.when(mine, low)).alias(f"{_P}low_{r.metric}"))
    return best.groupBy(F.col("lang").alias(_P + "lang"), F.col("source").alias(_P + "source")).agg(*aggs)


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` with the reserved columns base_failed and kept."""
    failed, inside = _failed(), F.lit(True)
    for r in LIMITS:
        inside = inside & (ratio(r.metric) <= F.col(f"{_P}high_{r.metric}"))
        if r.both_sides:
            inside = inside & (ratio(r.metric) >= F.col(f"{_P}low_{r.metric}"))
    group = [F.coalesce("lang", F.lit("")) == F.col(_P + "lang"), F.coalesce("source", F.lit("")) == F.col(_P + "source")]
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    return measured.join(bounds, group, "left").withColumn(_P + "base_failed", failed).withColumn(
        _P + "kept", F.when(failed, False).otherwise(F.coalesce(inside, F.lit(True))))


def report(docs: DataFrame, min_group: int = 200) -> DataFrame:
    """(doc_id, counts, base_failed, kept) per row."""
    measured = stored(measure(docs, ["doc_id", "lang", "source"]), "quality-counts")
    bounds = stored(limits(stored(sketches(measured), "quality-sketches"), min_group), "quality-limits")
    return judged(measured, bounds).select(
        "doc_id", *[F.col(_P + c).alias(c) for c in [*COUNTS, "base_failed", "kept"]])


def keep(docs: DataFrame, min_group: int = 200) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    sketch = stored(sketches(measure(docs, ["lang", "source"])), "quality-sketches")
    bounds = stored(limits(sketch, min_group), "quality-limits")
    return judged(measure(docs, docs.columns), bounds).filter(F.col(_P + "kept")).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def oracle(min_group: int = 200) -> str:
    """DuckDB SQL for ``report``."""
    value = {"symbols_per_word": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines",
             "repeat_share": "n_repeat_words / n_words", "word_length": "word_chars / n_words"}
    points = " UNION ALL ".join(
        f"SELECT lang, source, '{r.metric}' AS metric, "
        f"{value[r.metric].replace(' / ', '::DOUBLE / ')} AS v FROM m WHERE n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words" for r in LIMITS)
    scopes = {"own": "lang, source", "by_lang": "lang", "overall": ""}
    ctes = []
    for name, keys in scopes.items():
        lead = f"{keys}, " if keys else ""
        ctes.append(
            f"{name}_bins AS (SELECT {lead}metric, bin, count(*) AS n FROM bins GROUP BY {lead}metric, bin), "
            f"{name}_cum AS (SELECT *, sum(n) OVER (PARTITION BY {lead}metric ORDER BY bin) AS upto, "
            f"sum(n) OVER (PARTITION BY {lead}metric) AS total FROM {name}_bins), "
            f"{name}_q AS (SELECT {lead}metric, max(total) AS n, " + ", ".join(
                f"min(CASE WHEN upto >= {q}::DOUBLE * total THEN CASE WHEN bin = -2147483648 THEN 0.0::DOUBLE "
                f"ELSE 2 * pow({GAMMA!r}::DOUBLE, bin) / {GAMMA + 1!r}::DOUBLE END END) AS q{round(100 * q)}"
                for q in QUANTILES) + f" FROM {name}_cum GROUP BY {lead}metric)")
    pick = ", ".join(f"CASE WHEN o.n >= {min_group} THEN o.{q} WHEN l.n >= {min_group} THEN l.{q} ELSE a.{q} END AS {q}"
                     for q in (f"q{round(100 * x)}" for x in QUANTILES))
    checks = []
    for r in LIMITS:
        v = f"(m.{value[r.metric].replace(' / ', '::DOUBLE / m.')})"
        sub = f"(SELECT {{}} FROM best b WHERE b.lang = m.lang AND b.source = m.source AND b.metric = '{r.metric}')"
        upper = f"b.q{round(100 * r.quantile)}"
        checks.append(f"{v} <= " + sub.format(f"{upper} + {r.reach}::DOUBLE * greatest({upper} - b.q50, {r.floor}::DOUBLE)"))
        if r.both_sides:
            checks.append(f"{v} >= " + sub.format(f"b.q25 - {r.reach}::DOUBLE * greatest(b.q50 - b.q25, {r.floor}::DOUBLE)"))
    word = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
             row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, {word}) AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
covered AS (SELECT r, count(DISTINCT p) AS n FROM
  (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY r),
m AS (SELECT w.doc_id, w.lang, w.source, len(ws)::BIGINT AS n_words,
        length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN covered ON covered.r = w.r),
points AS ({points}),
bins AS (SELECT lang, source, metric,
           CASE WHEN v > {TINY!r} THEN ceil(ln(v) / {math.log(GAMMA)!r}::DOUBLE)::BIGINT ELSE -2147483648 END AS bin FROM points),
{', '.join(ctes)},
best AS (SELECT o.lang, o.source, o.metric, {pick} FROM own_q o JOIN by_lang_q l ON l.lang = o.lang AND l.metric = o.metric
         JOIN overall_q a ON a.metric = o.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  CASE WHEN n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words THEN FALSE
       ELSE coalesce({' AND '.join(checks)}, TRUE) END AS kept
FROM m"""
