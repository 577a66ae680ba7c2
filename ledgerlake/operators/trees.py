"""Gradient-boosted regression trees over feature rows, several models at a time.

The fit is that of MLlib's GBTRegressor with squared loss, step for step: the same
candidate cuts (from the same sample of the rows), gains of variance from sums of
labels and their squares, leaf rules, first tree in full and later ones by ``step``
along the gradient, and additions in the order of the rows of a partition. What differs
is the form of the rows: MLlib caches objects, some hundreds of bytes a row, and fits
one model after the other. Here a row is a byte a feature and two doubles, in arrays of
``CHUNK`` rows, and one pass a tree level serves all models that are fitted together.
A pass gives sums by node, feature and bin, whose size does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import ship_package

#: MLlib's default of bins a feature, and the rows from which it takes a sample for the cuts.
BINS, CUT_ROWS = 32, 10_000
#: Rows of a chunk; trees after which the predictions so far are written with the rows.
CHUNK, REWRITE = 1 << 16, 3
#: Partitions whose sums go to the driver one by one; more are added up in groups first.
DIRECT, GROUP = 64, 32
_EPSILON = np.finfo(np.float64).eps
_NONE = -np.finfo(np.float64).max


class Tree(NamedTuple):
    """A full binary tree, nodes by level: a row goes left of an inner node if
    ``x[feature] <= cut``; a node that does not split (feature -1) sends all left."""

    feature: np.ndarray
    cut: np.ndarray
    bin: np.ndarray  # the cut's place among its feature's cuts
    value: np.ndarray  # of the lowest level


class _Stats(NamedTuple):
    """Rows, sum and sum of squares of the labels of a node."""

    n: float
    s: float
    q: float

    def impurity(self) -> float:
        return float(_variance(*map(np.float64, self)))

    def prediction(self) -> float:
        return self.s / self.n if self.n else 0.0


def _variance(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


class BoostedTrees:
    """A model of ``n_trees`` trees over the columns ``names`` of ``rows`` (without nulls, read
    a few times, so give them computed). It is fitted when first used, or by ``fit_together``."""

    def __init__(self, rows: DataFrame, names: Sequence[str], label: str, n_trees: int, depth: int, step: float, seed: int):
        self.rows, self.names, self.label = rows, list(names), label
        self.n_trees, self.depth, self.step, self.seed = n_trees, depth, step, seed
        self.trees: list[Tree] = []

    def weight(self, tree: int) -> float:
        return 1.0 if tree == 0 else self.step

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``prediction``."""
        fit_together([self])
        parts = [(t.feature, t.cut, t.value, self.weight(i)) for i, t in enumerate(self.trees)]
        depth = self.depth

        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = [c.to_numpy(np.float64) for c in columns]
                out = np.zeros(len(x[0]))
                for feature, cut, value, weight in parts:
                    out += value.take(_leaf(x, feature, cut, depth)) * weight
                yield pd.Series(out)

        ship_package(df.sparkSession)
        return df.withColumn("prediction", F.pandas_udf(predict, "double")(*[F.col(n).cast("double") for n in self.names]))


def _leaf(x: Sequence[np.ndarray], feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The place in its level of every row after ``levels`` steps down."""
    feature, cut = feature.tolist(), cut.tolist()
    place = np.zeros(len(x[0]), np.uint8 if levels <= 8 else np.uint16)
    here: list = [None]  # the rows of each node: None all, False none
    for level in range(levels):
        right, below = np.zeros(len(place), bool), []
        for i, rows in enumerate(here, (1 << level) - 1):
            if rows is False or feature[i] < 0:
                below += [rows, False]
                continue
            r = ~(x[feature[i]] <= cut[i])
            if rows is not None:
                r &= rows
            right |= r
            below += [~r if rows is None else rows ^ r, r]
        place = (place << 1) | right
        here = below
    return place


def _cuts(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Rising candidate cuts of a feature: between all of its sampled values, or, if these are
    more than ``most`` + 1, at equal strides of rows. Zeros count as many as ``expected``
    rows leave."""
    v, m = np.unique(values[values != 0], return_counts=True)
    if not len(v):
        return np.zeros(0)
    m = m.astype(np.float64)
    zeros = expected - m.sum()
    if zeros > _EPSILON * m.sum() * 100:
        at = int(np.searchsorted(v, 0.0))
        v, m = np.insert(v, at, 0.0), np.insert(m, at, zeros)
    middles = (v[:-1] + v[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = expected / (most + 1)
    kept, upto, target = [], float(m[0]), stride
    for i, w in enumerate(m[1:].tolist()):
        before, upto = upto, upto + w
        if abs(before - target) < abs(upto - target):
            kept.append(middles[i])
            target += stride
    return np.array(kept)


def _edges(model: BoostedTrees) -> list[np.ndarray]:
    """Candidate cuts of every feature, from all rows if they are few, else from the sample
    that MLlib draws (about ``CUT_ROWS`` rows)."""
    spark, n = model.rows.sparkSession, model.rows.count()
    if n == 0:
        raise ValueError("no rows to fit trees to")
    fraction = CUT_ROWS / n if n > CUT_ROWS else 1.0
    columns = model.rows.select(*[F.col(c).cast("double").alias(c) for c in model.names])
    if fraction < 1:
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(model.seed).nextInt()
        drawn = columns._jdf.javaRDD().sample(False, fraction, seed)
        columns = DataFrame(spark._jsparkSession.createDataFrame(drawn, columns._jdf.schema()), spark)
    values = np.array(columns.collect(), np.float64).reshape(-1, len(model.names))
    return [_cuts(values[:, f], fraction * n, min(BINS, n) - 1) for f in range(len(model.names))]


def _chunks(model: BoostedTrees, edges: list[np.ndarray], k: int) -> RDD:
    """(model's number, bins by feature and row, labels, no predictions yet) of every chunk of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            y, *x = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            bins = np.stack([np.searchsorted(e, v, "left").astype(np.uint8) for e, v in zip(edges, x, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y)], names=["bins", "y"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
        if size:
            yield chunk()

    features = len(model.names)
    rows = model.rows.select(F.col(model.label).cast("double"), *[F.col(c).cast("double") for c in model.names])
    return rows.mapInArrow(run, "bins binary, y binary").rdd.map(
        lambda r: (k, np.frombuffer(r.bins, np.uint8).reshape(features, -1), np.frombuffer(r.y, np.float64), None))


def _predicted(bins: np.ndarray, before: np.ndarray | None, trees: list[tuple[Tree, float]], depth: int) -> np.ndarray | None:
    """The predictions ``before``, with those of ``trees``."""
    for tree, weight in trees:
        own = (tree.value * weight).take(_leaf(bins, tree.feature, tree.bin, depth))
        before = own if before is None else before + own
    return before


def _rewritten(plans: dict[int, tuple[list, int]]):
    def run(chunk):
        k, bins, y, before = chunk
        return k, bins, y, _predicted(bins, before, *plans[k])
    return run


def _sums(plans: dict[int, tuple], level: int):
    """Rows, labels and squares of a partition by (node that may split, feature, bin)."""
    def run(part: int, chunks: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, np.ndarray] = {}
        for k, bins, y, before in chunks:
            if k not in plans:
                continue
            trees, depth, feature, cut, slots = plans[k]
            before = _predicted(bins, before, trees, depth)
            label = y if before is None else 2.0 * (y - before)
            square = label * label
            base = (slots * BINS).take(_leaf(bins, feature, cut, level))
            many = (int(slots.max()) + 1) * BINS
            out = np.empty((3, many // BINS, len(bins), BINS))
            at = np.empty(len(y), np.intp)
            for f, own in enumerate(bins):
                np.add(base, own, out=at, casting="unsafe")
                for i, w in enumerate((None, label, square)):
                    out[i, :, f] = np.bincount(at, w, many).reshape(-1, BINS)
            found[k] = found[k] + out if k in found else out
        for k, out in found.items():
            yield (k, part // GROUP), out
    return run


def _summed(state: RDD, plans: dict[int, tuple], level: int) -> dict[int, np.ndarray]:
    sums = state.mapPartitionsWithIndex(_sums(plans, level))
    n = state.getNumPartitions()
    got = sums.collect() if n <= DIRECT else sorted(sums.reduceByKey(np.add, -(-n // GROUP)).collect(), key=lambda x: x[0])
    found: dict[int, np.ndarray] = {}
    for (k, _), out in got:
        found[k] = found[k] + out if k in found else out
    return found


class _Growth:
    """A tree of which levels are added."""

    def __init__(self, depth: int):
        nodes = (1 << depth) - 1
        self.feature, self.cut, self.bin = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes, np.int64)
        self.stats: dict[int, _Stats] = {}  # of the nodes that are there; the root's come with its sums
        self.open, self.depth = [0], depth

    def slots(self, level: int) -> np.ndarray:
        """Where each node of the level is counted; those that do not split, behind the others."""
        out = np.full(1 << level, len(self.open), np.int64)
        out[np.array(self.open) - ((1 << level) - 1)] = np.arange(len(self.open))
        return out

    def split(self, level: int, sums: np.ndarray, edges: list[np.ndarray]) -> None:
        grown = []
        for i, node in enumerate(self.open):
            found = self._best(node, sums[:, i], edges)
            if found is None:
                continue
            f, b, left, right = found
            self.feature[node], self.cut[node], self.bin[node] = f, edges[f][b], b
            for child, stats in ((2 * node + 1, left), (2 * node + 2, right)):
                self.stats[child] = stats
                if level + 1 < self.depth and not abs(stats.impurity()) < _EPSILON:
                    grown.append(child)
        self.open = grown

    def _best(self, node: int, sums: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int, _Stats, _Stats] | None:
        """(feature, place of the cut, statistics of both sides) of the split that gains most,
        the first of equals; None if none gains."""
        upto = sums.cumsum(2)
        best, gained = None, None
        for f, e in enumerate(edges):
            if not len(e):
                continue
            left, whole = upto[:, f, :len(e)], upto[:, f, len(e)][:, None]
            right = whole - left
            if node not in self.stats:
                self.stats[node] = _Stats(*(left[:, 0] + right[:, 0]).tolist())
            n = left[0] + right[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = self.stats[node].impurity() - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
            gain = np.where((left[0] >= 1) & (right[0] >= 1) & (gain >= 0), gain, _NONE)
            b = int(np.argmax(gain))
            if gained is None or gain[b] > gained:
                best, gained = (f, b, _Stats(*left[:, b].tolist()), _Stats(*right[:, b].tolist())), gain[b]
        if node not in self.stats:
            self.stats[node] = _Stats(*sums[:, 0].sum(1).tolist())
        return best if best and gained > 0 else None

    def tree(self) -> Tree:
        value = np.zeros(1 << self.depth)
        for place in range(1 << self.depth):
            node = (1 << self.depth) - 1 + place
            while node not in self.stats:
                node = (node - 1) // 2
            value[place] = self.stats[node].prediction()
        return Tree(self.feature, self.cut, self.bin, value)


def fit_together(models: Sequence) -> None:
    """Fit those of ``models`` that are boosted trees not yet fitted, all in the same passes."""
    models = [m for m in models if isinstance(m, BoostedTrees) and not m.trees]
    if not models:
        return
    spark = models[0].rows.sparkSession
    ship_package(spark)
    edges = [_edges(m) for m in models]
    chunks = [_chunks(m, e, k) for k, (m, e) in enumerate(zip(models, edges, strict=True))]
    state = spark.sparkContext.union(chunks).persist(StorageLevel.MEMORY_AND_DISK)
    before, since = None, 0
    grown: list[list[Tree]] = [[] for _ in models]
    for t in range(max(m.n_trees for m in models)):
        trees = {k: [(x, models[k].weight(i)) for i, x in enumerate(own)][since:] for k, own in enumerate(grown)}
        if t - since == REWRITE:
            before, state = state, state.map(_rewritten({k: (trees[k], models[k].depth) for k in trees})).persist(StorageLevel.MEMORY_AND_DISK)
            since, trees = t, {k: [] for k in trees}
        now = {k: _Growth(m.depth) for k, m in enumerate(models) if t < m.n_trees}
        for level in range(max(g.depth for g in now.values())):
            plans = {k: (trees[k], g.depth, g.feature, g.bin, g.slots(level)) for k, g in now.items() if level < g.depth and g.open}
            if not plans:
                break
            for k, sums in _summed(state, plans, level).items():
                now[k].split(level, sums, edges[k])
            if before is not None:
                before.unpersist()
                before = None
        for k, g in now.items():
            grown[k].append(g.tree())
    state.unpersist()
    for m, own in zip(models, grown, strict=True):
        m.trees = own
