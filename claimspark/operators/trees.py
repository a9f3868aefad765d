"""Decision trees grown from histograms of all training rows.

Features are cut at quantiles into at most 256 bins.  A level of a tree (or of
all trees of a forest at once) is one job: every task adds up, per open node,
feature and bin, what a split needs to know; Spark brings a node's cells together,
sums them, runs along the bins and keeps the node's best split.  Rows are never
sorted or moved; what reaches the driver is the splits, and of a boosted tree's level
with up to ``GATHERED_CELLS`` sums in all tasks these instead.

* ``fit_boosted``: gradient boosting of the log-loss with second-order gains and an
  L2 penalty on the leaves.  Gradients and hessians are integers of 2^-SCALE, so
  sums are exact and the trees are the same however the rows are partitioned.
  Rows lie in blocks with their gradients, made once a round and kept by Spark;
  they are written to the shared folder every ``KEEP_ROUNDS`` rounds.  Features of few
  bins are summed together (``Bundles``), and of two siblings only the smaller is counted.
* ``fit_forest``: Gini trees on Poisson bootstrap weights, a hash of row and tree,
  each node choosing among a few features; nodes are split until they are pure.

Cells of a job: open nodes x bins; a task of a forest's level goes through its rows
for ``MAX_CELLS`` of them at a time.  A forest's trees are grown in groups of so many
that a task holds about ``TASK_DRAWN`` drawn rows, and kept in 15 bytes a node.  Ties go
to the first feature, then the first bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import delete_dir, free_shuffles, shared_dir

#: Gradients are whole numbers of 2^-SCALE; their sums fit a long for 5e11 rows.
SCALE = 24
KEEP_ROUNDS = 10
MAX_CELLS = 2_000_000
#: Drawn rows of all trees that grow together, a task.
TASK_DRAWN = 12_000_000
#: Bytes of blocks that a task holds to go through them for several groups of cells.
HELD_BYTES = 32_000_000
#: Rows that a task scores at once, tree after tree.
SCORED_ROWS = 1 << 17
#: Sums of a boosted tree's level that all tasks together send to the driver; more are brought together by a shuffle.
GATHERED_CELLS = 4_000_000


# --- bins ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Upper edges of each feature's bins but the last: x lies in the first bin
    whose edge is not below it."""

    names: list[str]
    edges: list[np.ndarray]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Columns ``keep`` and ``bins``, a byte for each feature."""
        edges = self.edges
        kept = df.select(*keep)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", bins binary"

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = batch.num_columns - len(edges)
                found = np.column_stack([np.searchsorted(e, batch.column(m + i).to_numpy(zero_copy_only=False))
                                         for i, e in enumerate(edges)]).astype(np.uint8)
                offsets = pa.py_buffer(np.arange(0, found.size + 1, len(edges), dtype=np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:m], packed], names=[*batch.schema.names[:m], "bins"])

        values = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(self.names)]
        return df.select(*keep, *values).mapInArrow(cut, schema)


#: Values that a task holds before it sorts them, and distinct ones that a sketch keeps by accuracy.
_SKETCH_ROWS, _TASK_FINE, _MERGE_FINE = 1 << 19, 8, 32


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the sorted ``values``, evenly by rank; each counts for all since the one before."""
    if len(values) <= most:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.searchsorted(upto, -(-np.arange(1, most + 1) * int(upto[-1]) // most)))
    return values[at], np.diff(upto[at], prepend=0)


def _added(parts: Sequence[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch (sorted values, counts) of all ``parts`` together."""
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return _thinned(values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64), most)


def fit_bins(df: DataFrame, names: Sequence[str], max_bins: int = 256, accuracy: int = 10_000) -> Bins:
    """Quantile edges of every feature: the smallest values that so many rows do not
    exceed.  Every task sorts its values and hands on a sketch of each feature; a
    feature's sketches are merged in one place.  Exact for up to ``2 * accuracy``
    distinct values a feature, else ranks are about a share of ``1 / accuracy`` off."""
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must lie between 2 and 256")
    k = len(names)
    empty = (np.zeros(0), np.zeros(0, np.int64))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(k)]
        kept, rows = [empty] * k, 0

        def fold() -> None:
            for i, part in enumerate(held):
                if part:
                    kept[i] = _added([kept[i], np.unique(np.concatenate(part), return_counts=True)], _TASK_FINE * accuracy)
                    part.clear()

        for batch in batches:
            for i in range(k):
                held[i].append(batch.column(i).drop_null().to_numpy(zero_copy_only=False).copy())
            rows += batch.num_rows
            if rows >= _SKETCH_ROWS:
                fold()
                rows = 0
        fold()
        found = [_thinned(*x, 2 * accuracy) for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *(pa.array([x[j].tobytes() for x in found], pa.binary()) for j in (0, 1))],
                                         names=["feature", "value", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for feature, value, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                parts = held.setdefault(feature, [])
                parts.append((np.frombuffer(value.as_buffer(), float).copy(), np.frombuffer(n.as_buffer(), np.int64).copy()))
                if sum(len(v) for v, _ in parts) > 4 * _MERGE_FINE * accuracy:
                    parts[:] = [_added(parts, _MERGE_FINE * accuracy)]
        for feature, parts in held.items():
            values, n = _added(parts, _MERGE_FINE * accuracy)
            upto = np.cumsum(n)
            ranks = -(-np.arange(1, max_bins) * int(upto[-1]) // max_bins) if len(n) else np.zeros(0, np.int64)
            edges = np.unique(values[np.searchsorted(upto, ranks)])
            yield pa.RecordBatch.from_arrays([pa.array([feature], pa.int32()), pa.array([edges.tobytes()], pa.binary())], names=["feature", "edges"])

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    found = (values.mapInArrow(sketch, "feature int, value binary, n binary").repartition("feature")
             .mapInArrow(merge, "feature int, edges binary").collect())  # a row for each feature
    edges = {r["feature"]: np.frombuffer(bytes(r["edges"]), float) for r in found}
    return Bins(list(names), [edges.get(i, np.zeros(0)) for i in range(k)])


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    flat = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    start = column.offset * features
    return flat[start:start + len(column) * features].reshape(-1, features)


# --- trees -----------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in the order in which they were made; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)  # bins up to this one go left
    left: list[int] = field(default_factory=list)  # the right child is the next node
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, value: float, rows: int, depth: int) -> int:
        for part, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, value), (self.gain, 0.0),
                        (self.rows, rows), (self.depth, depth)):
            part.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple, right: tuple) -> tuple[int, int]:
        """Make ``node`` an inner node; ``left`` and ``right`` are (value, rows)."""
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        return self.add(*left, self.depth[node] + 1), self.add(*right, self.depth[node] + 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        return (*(np.array(x) for x in (self.feature, self.cut, self.left, self.value)), max(self.depth, default=0))


@dataclass(frozen=True)
class GrownTree:
    """A whole tree as ``Tree``, in about 15 bytes a node.  Its nodes lie level by level, so
    the children of inner node number j, counted from 0, are 1 + 2j and 2 + 2j."""

    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray
    ones: np.ndarray  # rows of label 1
    gains: np.ndarray  # of the inner nodes
    levels: np.ndarray  # nodes of each level

    @property
    def left(self) -> np.ndarray:
        out = np.zeros(len(self.feature), np.int32)
        out[self.feature >= 0] = 1 + 2 * np.arange(len(self.gains))
        return out

    @property
    def value(self) -> np.ndarray:
        return self.ones / np.maximum(self.rows, 1)

    @property
    def gain(self) -> np.ndarray:
        out = np.zeros(len(self.feature))
        out[self.feature >= 0] = self.gains
        return out

    @property
    def depth(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.levels)), self.levels)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        return self.feature, self.cut, self.left, self.value, len(self.levels) - 1


def leaf_of(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    feature, cut, left, _, depth = tree
    node = np.zeros(len(bins), np.int64)
    on = np.arange(len(bins))  # rows that are not at a leaf yet
    for _ in range(depth):
        at = node[on]
        f = feature[at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            break
        if len(inner) < len(on):
            on, at, f = on[inner], at[inner], f[inner]
        node[on] = left[at] + (bins[on, f] > cut[at])
    return node


class Bundles:
    """Features of few bins that share a byte: a bundle's code spells the bins of its
    features, and sums by code give the sums of each feature's bins."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = [int(x) for x in sizes]
        self.members: list[list[int]] = []
        self.codes: list[int] = []  # different codes of each bundle
        for f in sorted(range(len(sizes)), key=lambda f: -self.sizes[f]):
            b = next((b for b, n in enumerate(self.codes) if n * self.sizes[f] <= 256), len(self.codes))
            if b == len(self.codes):
                self.members.append([])
                self.codes.append(1)
            self.members[b].append(f)
            self.codes[b] *= self.sizes[f]
        self.place = {f: (b, i) for b, own in enumerate(self.members) for i, f in enumerate(own)}

    def pack(self, bins: np.ndarray) -> np.ndarray:
        """(bundles, rows) of ``bins`` (rows, features)."""
        out = np.zeros((len(self.members), len(bins)), np.uint8)
        for code, own in zip(out, self.members):
            for f in own:
                code *= np.uint8(self.sizes[f] % 256)  # 256 stands alone: its code is still 0
                code += bins[:, f]
        return out

    def bins_of(self, codes: np.ndarray, feature: int) -> np.ndarray:
        b, i = self.place[feature]
        own, x = self.members[b], codes[b]
        after = int(np.prod([self.sizes[f] for f in own[i + 1:]], dtype=int))
        if after > 1:
            x = x // np.uint8(after)
        return x % np.uint8(self.sizes[feature]) if i else x

    def sums_of(self, totals: Sequence[np.ndarray]) -> np.ndarray:
        """(..., cells): the sums of every feature's bins, from those of each bundle's codes, (..., codes)."""
        out: list = [None] * len(self.sizes)
        for total, own in zip(totals, self.members):
            lead = total.shape[:-1]
            cube = total.reshape(*lead, *(self.sizes[f] for f in own))
            for i, f in enumerate(own):
                out[f] = cube.sum(axis=tuple(len(lead) + j for j in range(len(own)) if j != i))
        return np.concatenate(out, axis=-1)

    def leaf_of(self, tree: tuple, codes: np.ndarray) -> np.ndarray:
        """As ``leaf_of``; a small tree's nodes are gone through for all rows at once."""
        feature, cut, left, *_ = tree
        if len(feature) > 256:
            return leaf_of(tree, np.stack([self.bins_of(codes, f) for f in range(len(self.sizes))], axis=1))
        node = np.zeros(codes.shape[1], np.uint8)
        bins: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(feature >= 0).tolist():  # a node comes before its children
            f = int(feature[i])
            if f not in bins:
                bins[f] = self.bins_of(codes, f)
            step = (bins[f] > cut[i]).view(np.uint8)
            step += np.uint8(left[i] - i)
            step *= node == i
            node += step
        return node


@dataclass
class TreeModel:
    """Trees over binned features; ``boosted`` adds leaf values to ``base`` and takes
    the logistic function, a forest takes the mean of the leaf values."""

    bins: Bins
    trees: list[Tree] | list[GrownTree]
    boosted: bool
    base: float = 0.0

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Columns ``keep``, ``probability`` and ``prediction``."""
        rows = self.bins.apply(df, keep)
        trees, features = df.sparkSession.sparkContext.broadcast(self.trees), len(self.bins.names)
        boosted, base = self.boosted, self.base
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("bins").schema) + ", probability double"

        def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = np.concatenate([_matrix(batch.column(batch.num_columns - 1), features) for batch in held])
            total = np.zeros(len(bins))
            for tree in trees.value:
                arrays = tree.arrays()  # of one tree at a time
                total += arrays[3][leaf_of(arrays, bins)]
            p = 1 / (1 + np.exp(-(base + total))) if boosted else total / max(1, len(trees.value))
            ends = np.cumsum([batch.num_rows for batch in held])
            for batch, end in zip(held, ends):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p[end - batch.num_rows:end])], names=[*batch.schema.names[:-1], "probability"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= SCORED_ROWS:
                    yield from scored(held)
                    held = []
            if held:
                yield from scored(held)

        return rows.mapInArrow(run, schema).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def splits(self) -> list[tuple]:
        """(tree, node, depth, feature, threshold, gain, rows) of every inner node."""
        out = []
        for t, tree in enumerate(self.trees):
            feature, cut, depth, gain, rows = (np.asarray(x) for x in (tree.feature, tree.cut, tree.depth, tree.gain, tree.rows))
            at = np.flatnonzero(feature >= 0)
            out += [(t, i, d, self.bins.names[f], float(self.bins.edges[f][c]), g, n)
                    for i, d, f, c, g, n in zip(*(x[at].tolist() for x in (np.arange(len(feature)), depth, feature, cut, gain, rows)))]
        return out

    def importances(self) -> dict[str, float]:
        """Each feature's mean gain (boosted) or summed impurity decrease (forest), as shares."""
        k = len(self.bins.names)
        sums, times = np.zeros(k), np.zeros(k, np.int64)
        for tree in self.trees:
            feature, gain = np.asarray(tree.feature), np.asarray(tree.gain)
            at = np.flatnonzero(feature >= 0)
            sums += np.bincount(feature[at], gain[at], k)
            times += np.bincount(feature[at], minlength=k)
        total = dict(zip(self.bins.names, (sums / np.maximum(times, 1) if self.boosted else sums).tolist()))
        whole = sum(total.values())
        return {k: v / whole if whole else 0.0 for k, v in total.items()}


# --- boosting ----------------------------------------------------------------------------------

BLOCK_ROWS = 1 << 15
_BLOCK = "label binary, codes binary, margin binary, g binary, h binary"


def _block(label: np.ndarray, codes: np.ndarray, margin: np.ndarray) -> tuple[bytes, ...]:
    """A block of rows, bundle by bundle, their margins, and the gradients
    and hessians at these as whole numbers of 2^-SCALE."""
    chance = 1 / (1 + np.exp(-margin))
    unit = float(1 << SCALE)
    return (label.astype(np.uint8).tobytes(), codes.tobytes(), margin.tobytes(), np.rint((chance - label) * unit).astype(np.int32).tobytes(),
            np.rint(chance * (1 - chance) * unit).astype(np.int32).tobytes())


def _blocks(rows: DataFrame, bundles: Bundles, base: float) -> DataFrame:
    """``rows`` (label, bins) in blocks of up to ``BLOCK_ROWS``, every margin ``base``."""
    features = len(bundles.sizes)
    names = ["label", "codes", "margin", "g", "h"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            y, x = (np.concatenate(part) for part in zip(*held))
            held.clear()
            block = _block(y, bundles.pack(x), np.full(len(y), base))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in block], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                held.append((piece.column(0).to_numpy(zero_copy_only=False).copy(), _matrix(piece.column(1), features).copy()))
                if sum(len(y) for y, _ in held) >= BLOCK_ROWS:
                    yield packed()
        if held:
            yield packed()

    return rows.mapInArrow(pack, _BLOCK)


def fit_boosted(rows: DataFrame, bins: Bins, rounds: int = 100, max_depth: int = 6, step: float = 0.3, l2: float = 1.0,
                min_child_weight: float = 1.0) -> TreeModel:
    """Boosted trees on every row of ``rows`` (label, bins), log-loss, gain
    GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2) as in second-order boosting.

    A round's margins and gradients are made once, kept by Spark while its levels
    read them, and follow from the round before; every ``KEEP_ROUNDS`` rounds they
    are written, so a lost executor repeats no more than these."""
    spark = rows.sparkSession
    rows = rows.select(F.col("label").cast("double").alias("label"), "bins")
    first = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = first["n"], first["p"] or 0.0
    model = TreeModel(bins, [], True, float(np.log(p / (n - p))) if 0 < p < n else 0.0)
    if not 0 < p < n:
        model.base = -30.0 if n and not p else 30.0 if n else 0.0
        return model
    sizes = bins.sizes
    bundles = Bundles(sizes)
    width = int(sizes.sum())
    offset = np.cumsum(sizes) - sizes
    feature_of = np.repeat(np.arange(len(sizes)), sizes)
    unit = float(1 << SCALE)

    def worth(g, h):
        return (g / unit) ** 2 / (h / unit + l2)

    def level(blocks: RDD, tree: Tree, pairs: list[tuple], open_nodes: list[int],
              known: dict[int, np.ndarray]) -> tuple[dict[int, tuple], dict[int, np.ndarray]]:
        """{node: (totals, best split or None)} of the open nodes, and their sums if these came
        here.  ``pairs`` (parent, left, right) holds the nodes made by the level before: where a
        parent's sums are ``known``, its smaller child is counted and the other is the difference."""
        grown = tree.arrays()
        less = [(parent, *sorted(pair, key=lambda i: tree.rows[i])) for parent, *pair in pairs if parent in known]
        counted = [few for _, few, _ in less] if known else open_nodes
        gathered = tasks * 3 * len(counted) * width <= GATHERED_CELLS
        counted = counted if gathered else open_nodes
        place = np.full(max(256, len(tree.feature)), -1)
        place[counted] = np.arange(len(counted))
        m = len(counted)

        def sums(found: Iterator[tuple]) -> np.ndarray:
            """(3, nodes, cells): sums of g, h and rows of every bin of a counted node."""
            total = [np.zeros((3, m, size)) for size in bundles.codes]  # whole numbers below 2^53 a task
            for _, codes, _, *parts in found:
                g, h = (np.frombuffer(v, np.int32).astype(float) for v in parts)
                codes = np.frombuffer(codes, np.uint8).reshape(len(total), -1)
                at = place[bundles.leaf_of(grown, codes)]
                mine = np.flatnonzero(at >= 0)
                if len(mine) < len(at):
                    at, g, h = at[mine], g[mine], h[mine]
                for x, size, out in zip(codes, bundles.codes, total):
                    cell = x[mine] if len(mine) < len(x) else x
                    cell = at * size + cell if m > 1 else cell.astype(np.int64)
                    for one, value in zip(out, (g, h, None)):
                        one += np.bincount(cell, value, m * size).reshape(m, size)
            return bundles.sums_of(total).astype(np.int64)

        def best_of(node: int, x: np.ndarray) -> tuple:
            before = np.cumsum(x, axis=1)
            left = before - (before[:, offset] - x[:, offset])[:, feature_of]
            whole = x[:, :sizes[0]].sum(axis=1)  # every row lies in one bin of the first feature
            (g, h, rows_left), (g_all, h_all, n_all) = left, whole
            valid = ((rows_left > 0) & (rows_left < n_all) & (h >= min_child_weight * unit)
                     & (h_all - h >= min_child_weight * unit))
            gain = np.full(width, -np.inf)
            at = np.flatnonzero(valid)
            gl, hl, ga, ha = g[at].astype(float), h[at].astype(float), float(g_all), float(h_all)
            gain[at] = worth(gl, hl) + worth(ga - gl, ha - hl) - worth(ga, ha)
            best = int(np.argmax(gain))  # ties: the first feature, then the first bin
            return (node, float(gain[best]), int(feature_of[best]), int(best - offset[feature_of[best]]),
                    *left[:, best].tolist(), *whole.tolist())

        here: dict[int, np.ndarray] = {}
        if gathered:  # no rows, and few cells whatever the rows: no second stage
            total = np.zeros((3, m, width), np.int64)
            for cells in blocks.mapPartitions(lambda found: [sums(found).tobytes()]).collect():
                total += np.frombuffer(cells, np.int64).reshape(total.shape)
            here = {node: total[:, i] for i, node in enumerate(counted)}
            if known:
                here |= {rest: known[parent] - here[few] for parent, few, rest in less}
            best = [best_of(node, here[node]) for node in open_nodes]
        else:
            cells = blocks.mapPartitions(lambda found: zip(counted, sums(found).transpose(1, 0, 2)))
            best = cells.reduceByKey(lambda x, y: x + y).map(lambda x: best_of(*x)).collect()
        return {r[0]: (tuple(r[7:]), (r[1], r[2], r[3], tuple(r[4:7])) if r[1] > 0 else None)
                for r in sorted(best, key=lambda r: r[0])}, here

    def leaf(g: float, h: float) -> float:
        return -step * g / (h + l2 * unit)

    blocks = _blocks(rows, bundles, model.base).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = blocks.getNumPartitions()
    before, path = None, None
    try:
        for number in range(rounds):
            tree = Tree()
            tree.add(0.0, n, 0)
            open_nodes, pairs, known = [0], [], {}
            for depth in range(max_depth):
                found, known = level(blocks, tree, pairs, open_nodes, known)
                if depth == 0:
                    tree.value[0] = leaf(*found[0][0][:2])
                    if before is not None:  # this round's blocks are complete
                        before.unpersist()
                        before = None
                pairs = []
                for node, ((g_all, h_all, n_all), best) in found.items():
                    if best is not None:
                        worth_of, feature, cut, (g, h, rows_left) = best
                        pairs.append((node, *tree.split(node, feature, cut, worth_of, (leaf(g, h), rows_left),
                                                        (leaf(g_all - g, h_all - h), n_all - rows_left))))
                pairs = [pair for pair in pairs if tree.rows[pair[0]] > 2]  # else no child has rows to split
                open_nodes = [i for _, *pair in pairs for i in pair if tree.rows[i] > 1]
                if not open_nodes:
                    break
            model.trees.append(tree)
            if len(tree.feature) == 1 and abs(tree.value[0]) < 1e-12 or number + 1 == rounds:
                break
            before, blocks = blocks, _with_margins(blocks, tree.arrays(), bundles)
            if (number + 1) % KEEP_ROUNDS == 0:
                new = shared_dir(spark, "margins")
                spark.createDataFrame(blocks, _BLOCK, verifySchema=False).write.parquet(new)
                blocks = spark.read.schema(_BLOCK).parquet(new).rdd.map(tuple)
                tasks = blocks.getNumPartitions()
                if path:
                    delete_dir(spark, path)
                path = new
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for part in (before, blocks):
            if part is not None:
                part.unpersist()
        if path:
            delete_dir(spark, path)
    return model


def _with_margins(blocks: RDD, tree: tuple, bundles: Bundles) -> RDD:
    """The blocks of the next round: margins with ``tree``'s leaves added."""

    def add(block: tuple) -> tuple[bytes, ...]:
        label, codes, margin, *_ = (np.frombuffer(x, kind) for x, kind in zip(block, (np.uint8, np.uint8, float)))
        codes = codes.reshape(len(bundles.members), -1)
        return _block(label, codes, margin + tree[3][bundles.leaf_of(tree, codes)])

    return blocks.map(add)


# --- forest -------------------------------------------------------------------------------------

#: Poisson(1): chance of at most 0, 1, ... draws.
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1) from a hash of its key."""
    x = _mixed(key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    chance = (x >> np.uint64(11)) * 2.0 ** -53
    drawn = np.zeros(len(x), np.int64)
    for upto in _POISSON:
        drawn += chance >= upto
    return drawn


def chosen(tree: int, node: int, features: int, few: int, seed: int) -> np.ndarray:
    """The features among which a node is split: those whose hashes are lowest."""
    x = np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += np.uint64(int(seed) * 0xD1B54A32D192ED03 + int(tree) * 0x8CB92BA72F3D8DD7 + int(node) * 0xAAAAAAAAAAAAAAAB & (1 << 64) - 1)
    return np.sort(np.argsort(_mixed(_mixed(x)), kind="stable")[:few])


#: Up to so many nodes the driver draws the features of; more are drawn by tasks, since a draw takes about 0.01 ms.
_DRAWN_HERE = 1_000


def chosen_all(spark: SparkSession, nodes: Sequence[tuple[int, int]], features: int, few: int, seed: int) -> np.ndarray:
    """``chosen`` of every (tree, node), (nodes, few)."""
    at = np.array(nodes)
    if len(at) <= _DRAWN_HERE:
        return np.array([chosen(t, node, features, few, seed) for t, node in at.tolist()])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False)
            picks = [chosen(t, node, features, few, seed).astype(np.int64).tobytes() for t, node in at[places].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picks, pa.binary())], names=["place", "picks"])

    tasks = min(spark.sparkContext.defaultParallelism, 1 + len(nodes) // 1_500)
    found = spark.range(0, len(nodes), 1, tasks).mapInArrow(draw, "place bigint, picks binary").toArrow()
    picks = np.frombuffer(b"".join(found.column("picks").to_pylist()), np.int64).reshape(-1, few)
    return picks[np.argsort(found.column("place").to_numpy())]


_DRAWN_ROWS = 1 << 15  # a row's number in its block fits 16 bits
_DRAWN = "label binary, bins binary, row binary, weight binary, node binary, size binary"


def _drawn_block(label: np.ndarray, bins: np.ndarray, row: np.ndarray, weight: np.ndarray, node: np.ndarray,
                 size: np.ndarray) -> tuple[bytes, ...]:
    """A block of rows feature by feature, and which of them lie how often in its open
    nodes: node by node, so many rows each."""
    return (label.astype(np.uint8).tobytes(), bins.tobytes(), row.astype(np.uint16).tobytes(), weight.astype(np.uint8).tobytes(),
            node.astype(np.int32).tobytes(), size.astype(np.int32).tobytes())


def _opened(block: tuple, features: int) -> list[np.ndarray]:
    kinds = (np.uint8, np.uint8, np.uint16, np.uint8, np.int32, np.int32)
    label, bins, *rest = (np.frombuffer(x, kind) for x, kind in zip(block, kinds))
    return [label, bins.reshape(features, -1), *rest]


def _drawn(rows: DataFrame, trees: int, features: int, seed: int, first: int = 0) -> DataFrame:
    """``rows`` (key, label, bins) in blocks, with the rows that each of so many ``trees`` from the
    ``first`` on draws at its root."""
    names = ["label", "bins", "row", "weight", "node", "size"]

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, y, x = (np.concatenate(part) for part in zip(*held))
        weight = [bootstrap(key, first + t, seed).astype(np.uint8) for t in range(trees)]
        row = [np.flatnonzero(w) for w in weight]
        block = _drawn_block(y, x.T, np.concatenate(row), np.concatenate([w[r] for w, r in zip(weight, row)]),
                             np.arange(trees), np.array([len(r) for r in row]))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in block], names=names)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, _DRAWN_ROWS - n)
                held.append((*(part.column(i).to_numpy(zero_copy_only=False).copy() for i in (0, 1)), _matrix(part.column(2), features).copy()))
                lo, n = lo + part.num_rows, n + part.num_rows
                if n == _DRAWN_ROWS:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(draw, _DRAWN)


def _moved(blocks: RDD, features: int, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> RDD:
    """The blocks a level on: every drawn row goes to a child of its node, or out if that is done."""
    cut = cut.astype(np.uint8)

    def move(block: tuple) -> list[tuple]:
        label, x, row, weight, node, size = _opened(block, features)
        at = np.repeat(feature[node].astype(np.int64) * x.shape[1], size) + row
        right = x.ravel()[at] > np.repeat(cut[node], size)
        ends = np.cumsum(size)
        upto = np.cumsum(right)[ends - 1]
        sizes = np.empty((len(size), 2), np.int64)  # left and right child of each node
        sizes[:, 1] = np.diff(upto, prepend=0)
        sizes[:, 0] = size - sizes[:, 1]
        to, sizes = child[node].ravel(), sizes.ravel()
        new = np.cumsum(sizes) - sizes
        order = np.empty(len(row), np.int64)
        for side, own in enumerate((np.flatnonzero(~right), np.flatnonzero(right))):
            n = sizes[side::2]
            order[np.arange(len(own)) + np.repeat(new[side::2] - np.cumsum(n) + n, n)] = own
        on = (to >= 0) & (sizes > 0)
        order = order[np.repeat(on, sizes)]
        if not len(order):
            return []
        row, used = row[order], np.zeros(x.shape[1], bool)
        used[row] = True
        left = np.flatnonzero(used)
        if 4 * len(left) < 3 * len(used):  # rows that no open node holds go
            label, x, row = label[left], x[:, left], (np.cumsum(used) - 1)[row]
        return [_drawn_block(label, x, row, weight[order], to[on], sizes[on])]

    return blocks.flatMap(move)


def fit_forest(rows: DataFrame, bins: Bins, trees: int = 100, max_depth: int | None = None, few: int | None = None,
               min_rows: int = 2, seed: int = 42) -> TreeModel:
    """Gini trees on every row of ``rows`` (key, label, bins); ``key`` is a 64-bit hash
    of the row's id.  ``few`` features a node (default the square root of all).  Without
    ``max_depth`` nodes are split until they are pure or no chosen feature parts them.

    Which rows lie in which open node is kept by Spark from level to level, and
    written every ``KEEP_ROUNDS`` levels.  The driver holds arrays only: a level's open
    nodes and the trees as ``GrownTree``."""
    spark = rows.sparkSession
    k = len(bins.names)
    few = few or max(1, int(np.sqrt(k)))
    rows = rows.select("key", F.col("label").cast("double").alias("label"), "bins")
    tasks = rows.rdd.getNumPartitions()
    together = max(1, min(trees, TASK_DRAWN * tasks // max(1, rows.count())))
    grown: list[GrownTree] = []
    while len(grown) < trees:
        first, n = len(grown), min(together, trees - len(grown))
        blocks = _drawn(rows, n, k, seed, first).rdd.map(tuple)
        grown += _grown(spark, blocks, bins.sizes, first, n, max_depth, few, min_rows, seed, tasks == 1)
        if len(grown) < trees:
            free_shuffles(spark)
    return TreeModel(bins, grown, False)


def _best_splits(blocks: RDD, sizes: np.ndarray, picks: np.ndarray, buckets_most: int, alone: bool) -> list[np.ndarray]:
    """Of every open node, in order: its number, the gain, feature and bin of its best split among
    its ``picks`` (gain 0 or less: none), rows and ones of the left side, rows and ones in all."""
    k, wide, most, held_bytes = len(sizes), picks.shape[1], MAX_CELLS, HELD_BYTES
    picks = picks.astype(np.uint8 if k <= 256 else np.int32)  # goes to the tasks

    def starts() -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes[picks].ravel())])  # the cells of each picked feature

    start = starts()
    buckets = min(buckets_most, 1 + int(start[-1]) // 50_000)
    node_start = start[::wide]
    edges = node_start[np.searchsorted(node_start, np.arange(1, buckets) * int(start[-1]) // buckets)] if buckets > 1 else start[:0]
    del start, node_start

    def impurity(n, p):
        return 2 * p * (n - p) / n

    def add(found: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        """(bucket, cells): the cells of whole nodes with their sums of rows and of label 1."""
        start = starts()
        node_start = start[::wide]

        def cells_of(held: list[list[np.ndarray]], first: int, end: int) -> Iterator[tuple[int, bytes]]:
            """Those of the nodes from ``first`` to before ``end``."""
            low_cell, cells = int(node_start[first]), int(node_start[end] - node_start[first])
            begin, own_picks = start[first * wide:end * wide].reshape(-1, wide) - low_cell, picks[first:end].astype(np.int64)
            both = np.zeros(cells)  # rows + 2^26 * those of label 1: whole numbers below 2^53
            n_sum, p_sum, counted = np.zeros(cells, np.int64), np.zeros(cells, np.int64), 0

            def fold() -> None:
                whole = both.astype(np.int64)
                n_sum[:] += whole & ((1 << 26) - 1)
                p_sum[:] += whole >> 26
                both[:] = 0

            for label, x, row, weight, node, size in held:
                lo, hi = np.searchsorted(node, [first, end])
                if lo == hi:
                    continue
                rows_of = x.shape[1]
                counted += len(_POISSON) * rows_of
                if counted >= 1 << 26:
                    fold()
                    counted = len(_POISSON) * rows_of
                ends = np.cumsum(size)
                own = slice(int(ends[lo] - size[lo]), int(ends[hi - 1]))
                row, at, size = row[own], node[lo:hi] - first, size[lo:hi]
                value = weight[own] * (1 + label * float(1 << 26))[row]
                for j in range(wide):
                    f, base = own_picks[at, j], begin[at, j]
                    cell = np.repeat(base, size) + x.ravel()[np.repeat(f * rows_of, size) + row]
                    low, high = int(base[0]), int(base[-1] + sizes[f[-1]])
                    if high - low > 4 * len(cell):  # many small nodes: most of the run stays as it is
                        np.add.at(both, cell, value)
                    else:
                        both[low:high] += np.bincount(cell - low, value, high - low)
            fold()
            used = np.flatnonzero(n_sum)
            found = np.stack([used + low_cell, n_sum[used], p_sum[used]])
            yield from ((b, c.tobytes()) for b, c in enumerate(np.split(found, np.searchsorted(found[0], edges), axis=1)) if c.size)

        def all_cells(held: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
            first = 0
            while first < len(picks):
                end = max(first + 1, int(np.searchsorted(node_start, node_start[first] + most, side="right")) - 1)
                yield from cells_of(held, first, end)
                first = end

        held, size = [], 0
        for block in found:
            held.append(_opened(block, k))
            size += sum(map(len, block))
            if size >= held_bytes:
                yield from all_cells(held)
                held, size = [], 0
        if held:
            yield from all_cells(held)

    def choose(found: Iterator[tuple[int, bytes]]) -> Iterator[list[np.ndarray]]:
        """node, gain, feature, bin, left rows and ones, all rows and ones of the best splits."""
        cell, n, p = np.zeros((3, 0), np.int64)
        held: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.concatenate([np.stack([cell, n, p]), *held], axis=1)
            held.clear()
            x = x[:, np.argsort(x[0], kind="stable")]
            edge = np.flatnonzero(np.diff(x[0], prepend=-1))
            return x[0, edge], np.add.reduceat(x[1], edge), np.add.reduceat(x[2], edge)

        for _, part in found:
            held.append(np.frombuffer(part, np.int64).reshape(3, -1))
            if sum(x.shape[1] for x in held) > most:
                cell, n, p = summed()
        if held:
            cell, n, p = summed()
        if not len(cell):
            return
        start = starts()
        slot = np.searchsorted(start, cell, side="right") - 1  # a run of bins: a node and one of its features
        node = slot // wide
        run = np.flatnonzero(np.diff(slot, prepend=-1))
        size = np.diff(np.append(run, len(slot)))
        left, whole = [], []
        for x in (n, p):
            before = np.cumsum(x)
            left.append(before - np.repeat(before[run] - x[run], size))
            whole.append(np.repeat(np.add.reduceat(x, run), size))
        value = np.full(len(cell), -np.inf)
        at = np.flatnonzero(left[0] < whole[0])
        (nl, pl), (na, pa_) = ((x[at].astype(float) for x in pair) for pair in (left, whole))
        value[at] = impurity(na, pa_) - impurity(nl, pl) - impurity(na - nl, pa_ - pl)
        own = np.flatnonzero(np.diff(node, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(value, own), np.diff(np.append(own, len(node))))
        top = np.flatnonzero(value == highest)  # ties: the first feature, then the first bin
        best = top[np.flatnonzero(np.diff(node[top], prepend=-1))]
        yield [node[best], value[best], picks.ravel()[slot[best]], cell[best] - start[slot[best]],
               *(x[best] for x in (*left, *whole))]

    cells = blocks.mapPartitions(add)
    cells = cells.coalesce(1) if alone else cells.partitionBy(buckets, lambda bucket: bucket)
    found = [np.concatenate(c) for c in zip(*cells.mapPartitions(choose).collect())]
    order = np.argsort(found[0]) if found else []
    return [x[order] for x in found]


def _grown(spark: SparkSession, blocks: RDD, sizes: np.ndarray, first: int, trees: int, max_depth: int | None, few: int,
           min_rows: int, seed: int, alone: bool) -> list[GrownTree]:
    """So many ``trees`` from the ``first`` on, grown together from the ``blocks`` of their drawn rows."""
    k, partitions = len(sizes), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.persist(StorageLevel.DISK_ONLY)
    before, path = None, None
    # a level's nodes, tree by tree: number of the tree, rows, ones, then feature, cut and gain of their splits
    tree, n, p = np.arange(trees, dtype=np.int32), np.zeros(trees, np.int64), np.zeros(trees, np.int64)
    open_at = np.arange(trees)  # which of the level's nodes are open
    nodes = np.zeros(trees, np.int64)  # of each tree, in the levels before
    levels: list[tuple[np.ndarray, ...]] = []
    try:
        for depth in count():
            feature, cut, gain = np.full(len(tree), -1, np.int16), np.zeros(len(tree), np.uint8), np.zeros(len(tree))
            levels.append((tree, n, p, feature, cut, gain))
            if not len(open_at) or depth == max_depth:
                break
            number = np.arange(len(tree)) - np.searchsorted(tree, tree) + nodes[tree]
            picks = chosen_all(spark, np.column_stack([first + tree, number])[open_at], k, few, seed)
            found = _best_splits(blocks, sizes, picks, partitions, alone)
            if not found:
                break
            place, worth, f, c, nl, pl, na, pa_ = found
            n[open_at[place]], p[open_at[place]] = na, pa_
            own = np.flatnonzero(worth > 0)
            at = open_at[place[own]]
            feature[at], cut[at], gain[at] = f[own], c[own], worth[own]
            nodes += np.bincount(tree, minlength=trees)
            # the children, left and right beside each other in the order of their parents
            tree = np.repeat(tree[at], 2)
            n, p = (np.column_stack([x, whole - x])[own].ravel() for x, whole in ((nl, na), (pl, pa_)))
            opened = (n >= min_rows) & (p > 0) & (p < n)
            child = np.full((len(open_at), 2), -1, np.int32)
            child[place[own]] = np.where(opened, np.cumsum(opened) - 1, -1).reshape(-1, 2)
            if before is not None:
                before.unpersist()
            before = None
            moved_by = np.zeros(len(open_at), np.int16), np.zeros(len(open_at), np.uint8)
            for out, x in zip(moved_by, (f, c)):
                out[place[own]] = x[own]
            open_at = np.flatnonzero(opened)
            if not len(open_at) or depth + 1 == max_depth:
                continue
            before, blocks = blocks, _moved(blocks, k, *moved_by, child)
            if (depth + 1) % KEEP_ROUNDS == 0:
                new = shared_dir(spark, "forest-rows")
                spark.createDataFrame(blocks, _DRAWN, verifySchema=False).write.parquet(new)
                blocks = spark.read.schema(_DRAWN).parquet(new).rdd.map(tuple)
                if path:
                    delete_dir(spark, path)
                path = new
            blocks = blocks.persist(StorageLevel.DISK_ONLY)
    finally:
        for part in (before, blocks):
            if part is not None:
                part.unpersist()
        if path:
            delete_dir(spark, path)
    by_level = [np.bincount(level[0], minlength=trees) for level in levels]
    out = []
    for t in range(trees):
        own = [slice(*np.searchsorted(level[0], [t, t + 1])) for level in levels]
        _, n, p, feature, cut, gain = (np.concatenate([level[i][part] for level, part in zip(levels, own)]) for i in range(6))
        small = np.int32 if n[0] < 1 << 31 else np.int64
        counts = np.array([by[t] for by in by_level])
        out.append(GrownTree(feature, cut, n.astype(small), p.astype(small), gain[feature >= 0], counts[counts > 0]))
    return out
