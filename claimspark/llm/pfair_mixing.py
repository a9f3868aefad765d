"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots; a slot takes one block of about ``block_chars`` characters
of one source.  A source with a of the period's S slots has weight a / S; its
j-th block is released at floor((j-1) S / a) and due at ceil(j S / a).  Every
slot takes the released block with the earliest deadline (ties: source name).
One block a slot and total weight 1 make that schedule feasible (Baruah et
al., Algorithmica 1996), so at any slot each source is less than one block
away from its target, for as long as all sources have blocks (``on_target``).

Within a source documents follow the MD5 of their id; a document starts in the
block its first character falls in, a long one spans several.  No document is
left out: when a source ends, the others keep their slots.

Everything is DataFrame and SQL functions.  The schedule of one period is an
``aggregate`` over its slots on a single row of per-source counts; periods
repeat it.  Scale: sizes are summed per (source, bucket of the order) with
partial aggregation, so neither the largest source nor the order ever passes
through one task; the windows hold about the square root of all rows.  The
period table has at most ``period`` rows plus one per source and is broadcast.

Defined cases: a null source counts as ''.  Null or empty text has size 0.
A null doc_id counts as '' in the order.  Repeated rows each get a slot.  An
empty table gives an empty result.  ``mixed`` passes other columns through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import stored

PERIOD, BLOCK_CHARS, ALPHA = 1024, 65_536, 0.5


def sized(docs: DataFrame, *carry: Column) -> DataFrame:
    """(doc_id, source, size, turn) and ``carry``: turn orders a source's documents."""
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"), *carry)


def slots_by_size(sizes: DataFrame, alpha: float = ALPHA, period: int = PERIOD) -> DataFrame:
    """(source, share): slots a period in proportion to size ** alpha, at least one."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("chars"))
    weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    return _shares(total.select("source", weight.alias("weight")), period)


def _shares(weights: DataFrame, period: int) -> DataFrame:
    whole = weights.agg(F.sum("weight")).first()[0] or 0.0
    share = F.floor(F.col("weight") / F.lit(whole) * period + 0.5) if whole > 0 else F.lit(1)
    return weights.select("source", F.greatest(share, F.lit(1)).cast("bigint").alias("share"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, share, period, nth, release, deadline, slot): one period, one row a slot."""
    one = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("s")).select(
        "s", F.expr("aggregate(s, 0L, (t, x) -> t + x.share)").alias("period"))
    step = """
      aggregate(
        sequence(0L, period - 1),
        named_struct('taken', transform(s, x -> 0L),
                     'slots', cast(array() as array<struct<deadline:bigint,i:int,nth:bigint,slot:bigint>>)),
        (state, slot) -> aggregate(
          array(array_min(filter(
            transform(s, (x, i) -> named_struct(
              'deadline', ((state.taken[i] + 1) * period + x.share - 1) div x.share, 'i', i,
              'nth', state.taken[i] + 1, 'slot', slot)),
            c -> ((c.nth - 1) * period) div s[c.i].share <= slot))),
          state,
          (held, pick) -> named_struct(
            'taken', transform(held.taken, (n, i) -> if(i = pick.i, n + 1, n)),
            'slots', concat(held.slots, array(pick)))),
        state -> state.slots)"""
    return (one.filter("size(s) > 0").withColumn("p", F.explode(F.expr(step)))
            .select(F.expr("s[p.i].source").alias("source"), F.expr("s[p.i].share").alias("share"), "period",
                    F.col("p.nth").alias("nth"),
                    F.expr("((p.nth - 1) * period) div s[p.i].share").alias("release"),
                    F.col("p.deadline").alias("deadline"), F.col("p.slot").alias("slot")))


def _bucket(buckets: int) -> Column:
    """Order-preserving: the leading 32 bits of ``turn`` scaled to ``buckets``."""
    return F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(4294967296)).cast("bigint")


class Schedule:
    """What places a document: the period and the sums per source and bucket,
    both small tables in the shared folder."""

    def __init__(self, docs: DataFrame, shares: DataFrame | None, block_chars: int, alpha: float, period: int):
        self.block_chars = block_chars
        sizes = stored(sized(docs), "mix-sizes")
        self.buckets = max(1, math.isqrt(sizes.count()))
        if shares is None:
            shares = slots_by_size(sizes, alpha, period)
        else:
            shares = sizes.select("source").distinct().join(shares, "source", "left").select(
                "source", F.greatest(F.coalesce("share", F.lit(1)), F.lit(1)).cast("bigint").alias("share"))
        self.slots = stored(schedule(shares), "mix-period")
        before = F.coalesce(F.sum("chars").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.sums = stored(sizes.groupBy("source", _bucket(self.buckets).alias("bucket")).agg(F.sum("size").alias("chars"))
                           .withColumn("before", before), "mix-buckets")
        self.sizes = sizes

    def ends(self) -> tuple[int, int]:
        """The last slot in use, and the first that lacks a block of its source."""
        last = F.expr(f"(greatest(chars, 1) - 1) div {self.block_chars} + 1")
        blocks = self.sums.groupBy("source").agg(F.max(F.col("before") + F.col("chars")).alias("chars")).select(
            "source", F.explode(F.array(last, last + 1)).alias("block"), last.alias("last"))
        used = F.col("block") == F.col("last")
        row = _slotted(blocks, self.slots).agg(F.max(F.when(used, F.col("slot"))), F.min(F.when(~used, F.col("slot")))).first()
        return (row[0] or 0), (row[1] or 0)

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows of ``sized`` with block, release, deadline and slot.  They meet
        their bucket once, for the running sum and the bucket's offset."""
        rows = rows.withColumn("bucket", _bucket(self.buckets))
        inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(
            Window.unboundedPreceding, -1)
        placed = (rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                  .join(self.sums.select("source", "bucket", "before"), ["source", "bucket"])
                  .withColumn("block", F.expr(f"(before + ahead) div {self.block_chars} + 1")))
        return _slotted(placed, self.slots)


def plan(docs: DataFrame, shares: DataFrame | None = None, block_chars: int = BLOCK_CHARS,
         alpha: float = ALPHA, period: int = PERIOD) -> DataFrame:
    """(doc_id, source, size, block, release, deadline, slot, on_target) per row.

    ``shares`` (source, share) gives the slots of a period; without it they
    follow the sizes (``slots_by_size``).  A source missing there gets one slot.
    """
    mix = Schedule(docs, shares, block_chars, alpha, period)
    return mix.place(mix.sizes).select("doc_id", "source", "size", "block", "release", "deadline", "slot",
                                       (F.col("slot") < mix.ends()[1]).alias("on_target"))


def _slotted(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows (source, block) with their release, deadline and slot."""
    share = slots.select("source", "share", "period").distinct()
    lap = F.expr("(block - 1) div share")
    out = rows.join(F.broadcast(share), "source").withColumn("lap", lap).withColumn(
        "nth", F.expr("(block - 1) % share + 1"))
    period = slots.select("source", "nth", F.col("release").alias("r"), F.col("deadline").alias("d"),
                          F.col("slot").alias("t"))
    shift = F.col("lap") * F.col("period")
    return out.join(F.broadcast(period), ["source", "nth"]).withColumns(
        {"release": F.col("r") + shift, "deadline": F.col("d") + shift, "slot": F.col("t") + shift})


def mixed(docs: DataFrame, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """``docs`` dealt to partitions by stretches of the schedule and sorted by
    slot in each, so that every written file holds the sources at their target
    weights.  The texts are shuffled twice: to their bucket, to their stretch."""
    mix = Schedule(docs, None, block_chars, alpha, period)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    stretches = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, (mix.ends()[0] + 1) // stretches)
    return (mix.place(sized(docs, whole)).withColumn("stretch", F.expr(f"slot div {width}"))
            .repartition("stretch").sortWithinPartitions("slot", "block").select("row.*"))


def oracle(alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> str:
    """DuckDB SQL for ``plan`` with shares by size (repeated ids aside)."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
w AS (SELECT source, pow(sum(size)::DOUBLE, {alpha}) AS weight FROM d GROUP BY source),
share AS (SELECT source, greatest(CASE WHEN (SELECT sum(weight) FROM w) > 0
    THEN floor(weight / (SELECT sum(weight) FROM w) * {period} + 0.5)::BIGINT ELSE 1 END, 1) AS share FROM w),
lists AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS a, sum(share)::BIGINT AS s FROM share),
step AS (
  SELECT -1::BIGINT AS slot, list_transform(a, lambda x: 0::BIGINT) AS taken, 0::BIGINT AS pick FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(taken, lambda n, i: CASE WHEN i = b THEN n + 1 ELSE n END), b FROM (
    SELECT slot, taken, (list_min(list_filter(list_transform(taken, lambda n, i:
        CASE WHEN (n * s) // a[i] <= slot + 1 THEN (((n + 1) * s + a[i] - 1) // a[i]) * 1000000 + i END),
        lambda c: c IS NOT NULL)) % 1000000)::BIGINT AS b
    FROM step, lists WHERE slot + 1 < s)),
slots AS (SELECT names[pick] AS source, a[pick] AS share, s, taken[pick] AS nth, slot,
    ((taken[pick] - 1) * s) // a[pick] AS r, (taken[pick] * s + a[pick] - 1) // a[pick] AS dl
  FROM step, lists WHERE slot >= 0),
placed AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {block_chars} + 1)::BIGINT AS block FROM d),
gap AS (SELECT min(q.slot + ((e.block - 1) // q.share) * q.s) AS g FROM
  (SELECT source, (greatest(sum(size), 1) - 1) // {block_chars} + 2 AS block FROM d GROUP BY source) e
  JOIN slots q ON q.source = e.source AND q.nth = (e.block - 1) % q.share + 1)
SELECT p.doc_id, p.source, p.size, p.block, (q.r + ((p.block - 1) // q.share) * q.s)::BIGINT AS release,
  (q.dl + ((p.block - 1) // q.share) * q.s)::BIGINT AS deadline,
  (q.slot + ((p.block - 1) // q.share) * q.s)::BIGINT AS slot,
  q.slot + ((p.block - 1) // q.share) * q.s < (SELECT g FROM gap) AS on_target
FROM placed p JOIN slots q ON q.source = p.source AND q.nth = (p.block - 1) % q.share + 1"""
