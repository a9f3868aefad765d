"""Near-duplicate pairs by a sweep over range partitions with halo exchange.

Rows are range-partitioned by (keys, day, id) into parts of about equal size,
so a hot key is spread over as many parts as its rows fill.  A part meets itself;
beyond its edge it meets another part only in the rows that share the edge's
keys and lie within the band of the other part's edge, the halo.  No other row is
copied.  Every meeting (part, part) is a cell of its own, so a task never holds
more than two parts, and runs once along the sorted days: the partners of a row
are one stretch of the other side, found by binary search.

Jobs: the parts are written once to the shared folder, their edges (a row a part)
are joined with each other on the keys, halos by a counted broadcast of the
meetings; then one shuffle by cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark import fixed_values as FV
from claimspark.session import BROADCAST_ROWS, stored

#: Pairs of an output batch.
_BATCH = 50_000


def sweep_pairs(df: DataFrame, keys: Sequence[str], id_col: str, date_col: str, lo: int = FV.DUPLICATE_MIN_DAYS,
                hi: int = FV.DUPLICATE_MAX_DAYS, carry: Sequence[str] = (), symmetric: bool = False,
                parts: int | None = None) -> DataFrame:
    """The pairs and columns of ``near_pairs``: equal keys, the smaller id first, a day
    gap in [lo, hi] (``symmetric``: either way).  Rows with a null key, id or date
    have no partner.  ``parts`` defaults to the session's shuffle partitions."""
    if hi < lo:
        raise ValueError("hi must be >= lo")
    keys = list(keys)
    carry = [c for c in carry if c not in keys]
    spark = df.sparkSession
    day = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date"))
    rows = df.select(*keys, id_col, date_col, *carry, day.alias("_day")).na.drop(subset=[*keys, id_col, date_col])
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *keys, "_day", id_col).withColumn("_part", F.spark_partition_id())
    cut = stored(cut, "sweep-parts")
    # the two sides of the band as gaps later - earlier of days, smaller id first or either
    least, most = (-hi, hi) if symmetric else (lo, hi)
    back, ahead = max(0, -least), max(0, most)
    reach = max(back, ahead)
    place = F.struct(*keys, "_day")
    edges = stored(cut.groupBy("_part").agg(F.min(place).alias("first"), F.max(place).alias("last")), "sweep-edges")
    ends = edges.select(*[F.col(f"last.{k}").alias(k) for k in keys], F.col("_part").alias("_p"), F.col("last._day").alias("_end"))
    starts = edges.select(*[F.col(f"first.{k}").alias(k) for k in keys], F.col("_part").alias("_q"), F.col("first._day").alias("_begin"))
    meetings = stored(ends.join(starts, keys).filter((F.col("_p") < F.col("_q")) & (F.col("_begin") <= F.col("_end") + reach)), "sweep-meetings")
    few = meetings.count() <= BROADCAST_ROWS

    def met(part: str) -> DataFrame:
        m = meetings.withColumnRenamed(part, "_part")
        return cut.join(F.broadcast(m) if few else m, [*keys, "_part"])

    own = cut.select("*", F.col("_part").alias("_p"), F.col("_part").alias("_q")).drop("_part")
    before = met("_p").filter(F.col("_day") >= F.col("_begin") - reach).withColumnRenamed("_part", "_p")
    after = met("_q").filter(F.col("_day") <= F.col("_end") + reach).withColumnRenamed("_part", "_q")
    halo = [side.withColumn("_side", F.lit(i)).select(*own.columns, "_side") for i, side in ((1, before), (2, after))]
    cells = own.withColumn("_side", F.lit(0)).unionByName(halo[0]).unionByName(halo[1])
    cells = cells.repartition("_p", "_q").sortWithinPartitions("_p", "_q", *keys, "_day", id_col)
    fields = {f.name: f for f in rows.schema.fields}
    out = T.StructType([*[fields[k] for k in keys], *[T.StructField(f"{id_col}_{i}", fields[id_col].dataType) for i in (1, 2)],
                        *[T.StructField(f"{c}_{i}", fields[c].dataType) for c in carry for i in (1, 2)],
                        *[T.StructField(f"date_{i}", fields[date_col].dataType) for i in (1, 2)], T.StructField("days_apart", T.IntegerType())])
    names = out.names

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            rank = _ranks(cell, keys)
            day = cell.column("_day").to_numpy().astype(np.int64)
            side = cell.column("_side").to_numpy()
            early = np.flatnonzero(side != 2)
            late = np.flatnonzero(side != 1)
            order = rank[late] * (1 << 32) + day[late]  # rises: the cell is sorted
            begin = np.searchsorted(order, rank[early] * (1 << 32) + day[early], "left")
            end = np.searchsorted(order, rank[early] * (1 << 32) + day[early] + reach, "right")
            for lo_row in _groups(end - begin):
                at = np.arange(*lo_row)
                size = end[at] - begin[at]
                a = np.repeat(early[at], size)
                ends = np.cumsum(size)
                b = late[np.repeat(begin[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                yield from _pairs(cell, a, b, day)

    def _pairs(cell: pa.Table, a: np.ndarray, b: np.ndarray, day: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows a lie no later than rows b; within a day each pair comes both ways."""
        same = day[a] == day[b]
        keep = ~same | (a < b)
        a, b = a[keep], b[keep]
        ids = cell.column(id_col).combine_chunks()
        if not len(a):
            return
        swap = _less(ids.take(pa.array(b)), ids.take(pa.array(a)))
        equal = _equal(ids.take(pa.array(a)), ids.take(pa.array(b)))
        one, two = np.where(swap, b, a), np.where(swap, a, b)
        gap = day[two] - day[one]
        fine = ~equal & ((np.abs(gap) >= lo) & (np.abs(gap) <= hi) if symmetric else (gap >= lo) & (gap <= hi))
        one, two, gap = one[fine], two[fine], gap[fine]
        for i in range(0, len(one), _BATCH):
            x, y = pa.array(one[i:i + _BATCH]), pa.array(two[i:i + _BATCH])
            columns = [cell.column(k).take(x) for k in keys] + [cell.column(id_col).take(x), cell.column(id_col).take(y)]
            for c in [*carry, date_col]:
                columns += [cell.column(c).take(x), cell.column(c).take(y)]
            columns.append(pa.array(gap[i:i + _BATCH], pa.int32()))
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    return cells.mapInArrow(sweep, out)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (_p, _q) run of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        p, q = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("_p", "_q"))
        cell = p * (1 << 31) + q
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), batch.num_rows]
        if held and cell[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = cell[-1]
    if held:
        yield pa.Table.from_batches(held)


def _ranks(cell: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """0, 0, 1, ...: which run of equal keys each row of a sorted table is in."""
    new = np.zeros(cell.num_rows, bool)
    for k in keys:
        code = cell.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new).astype(np.int64)


def _groups(size: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` partners in all."""
    upto = np.cumsum(size)
    start = 0
    while start < len(size):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
        yield start, end
        start = end


def _less(x: pa.Array, y: pa.Array) -> np.ndarray:
    return pc.less(x, y).to_numpy(zero_copy_only=False)


def _equal(x: pa.Array, y: pa.Array) -> np.ndarray:
    return pc.equal(x, y).to_numpy(zero_copy_only=False)
