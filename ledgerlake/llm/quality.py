"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are array passes over the bytes of a batch of texts. Training runs
on the driver over a bounded sample of labelled rows (``max_train``, taken by
hash of doc_id): features are cut into at most 64 quantile bins, trees grow
level by level from per-bin gradient sums, and the forest is flattened into
arrays of complete binary trees. Scoring is a narrow job over all documents:
each level of each tree is one vectorised step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import fresh
from ledgerlake.llm.textkit import flat, runs, slices, span_hashes, tidy, words

MAX_TRAIN = 20_000
FEATURES = ("bytes", "words", "mean_word", "longest_word", "upper", "digit", "punctuation", "pipe", "symbol", "newline",
            "high_byte", "repeated_byte", "distinct_words", "adjacent_equal", "top_word", "distinct_pairs", "symbol_end",
            "no_letter", "distinct_lines", "words_per_line")

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_PUNCT = (_B > 32) & (_B < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_B, [ord(c) for c in "#$%&*@^~<>{}[]\\_=+"])
_PLAIN_END = _LETTER | _DIGIT | np.isin(_B, [ord(c) for c in ".,;:!?)'\""])


def _distinct(d: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per row; size of each row's largest group."""
    o = np.lexsort((h, d))
    first = runs(d[o], h[o])
    size = np.diff(np.r_[first, len(o)])
    of = d[o][first]
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, size)
    return np.bincount(of, minlength=rows), top


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    rows = len(offs) - 1
    n = np.diff(offs).astype(float)
    out = np.zeros((rows, len(FEATURES)), np.float32)
    if not len(buf):
        return out
    def share(flags: np.ndarray, by: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags)]
        return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(by, 1)

    s, e, d = words(buf, offs)
    w = np.bincount(d, minlength=rows).astype(float)
    some = np.maximum(w, 1)
    length = e - s
    h = span_hashes(buf, s, e)
    kinds, top = _distinct(d, h, rows)
    near = d[1:] == d[:-1]
    pairs, _ = _distinct(d[1:][near], (h[:-1] * np.uint64(3) + h[1:])[near], rows)
    equal = np.bincount(d[1:][near & (h[1:] == h[:-1])], minlength=rows)
    letters = np.r_[0, np.cumsum(_LETTER[buf])]
    punct = _PUNCT[buf]
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, d, length)
    line = buf == 10
    ls = np.flatnonzero(np.r_[True, line[:-1]] | np.isin(np.arange(len(buf)), offs[:-1], assume_unique=False)) if len(buf) else np.zeros(0, int)
    le = np.r_[ls[1:], len(buf)]
    ld = np.searchsorted(offs[1:], ls, "right")
    full = le > ls
    lines = np.bincount(ld, minlength=rows)
    dl, _ = _distinct(ld[full], span_hashes(buf, ls[full], le[full]), rows)
    for i, v in enumerate((
            n, w, np.bincount(d, length, minlength=rows) / some, longest, share(_UPPER[buf], n), share(_DIGIT[buf], n),
            share(punct, n), share(buf == ord("|"), n), share(_SYMBOL[buf], n), share(line, n), share(buf >= 128, n),
            share(np.r_[False, (buf[1:] == buf[:-1]) & punct[1:]], n), kinds / some, equal / some, top / some, pairs / some,
            np.bincount(d[~_PLAIN_END[buf[e - 1]]], minlength=rows) / some,
            np.bincount(d[letters[e] == letters[s]], minlength=rows) / some, dl / np.maximum(lines, 1), w / np.maximum(lines, 1))):
        out[:, i] = v
    return out


@dataclass
class Forest:
    """Complete binary trees in flat arrays: node i of a tree has children 2i+1
    and 2i+2; a leaf that ends early repeats its value below."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = 2 ** self.depth - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
          ridge: float = 1.0, least: int = 5) -> Forest:
    """Boosted trees for the log loss; with one class only, its (smoothed) share."""
    inner = 2 ** depth - 1
    p = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))), depth)
    if not len(y) or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # x > edges[c] iff code > c
    margin = np.full(len(y), forest.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, w = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, base = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-9)
            cut = np.zeros(width, np.int64)
            place = node - base
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                at = place * k + code[:, j]
                G, H, N = (np.cumsum(np.bincount(at, v, width * k).reshape(width, k), 1) for v in (g, w, None))
                gt, ht, nt = G[:, -1:], H[:, -1:], N[:, -1:]
                gain = G ** 2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt ** 2 / (ht + ridge)
                gain[(N < least) | (nt - N < least)] = 0
                gain = gain[:, :-1]
                c = gain.argmax(1)
                better = gain[np.arange(width), c] > best
                best = np.where(better, gain[np.arange(width), c], best)
                for q in np.flatnonzero(better):
                    feature[base + q], threshold[base + q], cut[q] = j, e[c[q]], c[q]
            split = np.isfinite(threshold[node])
            right = split & (code[np.arange(len(y)), feature[node]] > cut[place])
            node = 2 * node + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, w, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(values), forest.base, depth)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Train on at most ``max_train`` labelled ids that are not held out.

    Labels with a null id or a quality other than 0 or 1 are ignored; an id with
    several labels counts once, with the lowest. The sample (ids by lowest hash)
    is bounded, so it may be broadcast and its statistics collected. An id that
    stands for several documents counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = (known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = flat(b.column(2))
            for i, j in slices(offs):
                x = statistics(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i),
                                                  pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
                .select("doc_id", "quality", "text").mapInArrow(run, T.StructType([
                    T.StructField("doc_id", labels.schema["doc_id"].dataType), T.StructField("quality", labels.schema["quality"].dataType),
                    T.StructField("x", T.ArrayType(T.FloatType()))]))
                .groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*", "doc_id")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train(np.array([r["x"] for r in rows], np.float32).reshape(-1, len(FEATURES)),
                 np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with the forest's probability of label 1. Null and empty texts are
    scored from zero statistics; repeated rows stay repeated; only the text is
    an input; a column called ``name`` is replaced."""
    rest = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())])
    at = len(rest)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = flat(b.column(at))
            got = [forest.score(statistics(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])) for i, j in slices(offs)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate([np.zeros(0), *got]))], names=[*rest, name])

    return docs.select(*rest, F.col("text").alias(fresh(rest, "_text"))).mapInArrow(run, schema)
