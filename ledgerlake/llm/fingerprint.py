"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its lower-cased words with their counts. For
each of ``SAMPLES`` places and each term, a uniform and two gamma variates are
derived from the term's hash alone; the term of weight w draws the level
t = floor(ln w / r + b) and competes with ln a = ln c - r (t - b + 1). The
smallest wins, and two documents have the same winner with probability
sum(min) / sum(max) of their weights (generalised Jaccard similarity). A place
of the fingerprint is 16 bits of the hash of the winner's value, which stands
for the winning term and level; likeness is the share of equal places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import partitions, range_bounds
from ledgerlake.llm.textkit import mix64, runs, span_hashes, tidy, words

SAMPLES = 64
BATCH_CHARS = 1 << 19
#: (term, text) pairs whose variates are held at once.
TERMS = 1 << 18


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    return ((mix64(h[:, None] + _SEED[salt]) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)


_SEED = mix64(np.arange(5 * SAMPLES, dtype=np.uint64) + np.uint64(7)).reshape(5, SAMPLES)


def _variates(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) scale r, ln of Gamma(2, 1) c and uniform b, per term and place."""
    r = -np.log(_uniform(h, 0) * _uniform(h, 1))
    c = np.log(-np.log(_uniform(h, 2) * _uniform(h, 3)))
    return r, c, _uniform(h, 4)


def _lower(best: np.ndarray, h: np.ndarray, d: np.ndarray, count: np.ndarray) -> None:
    """Take the values of the terms ``h`` of the texts ``d`` into ``best``, the least so far."""
    terms, back = np.unique(h, return_inverse=True)
    r, c, b = _variates(terms)
    once = c + r * b - r  # the value at weight 1, where the level is 0
    value = once[back]
    more = np.flatnonzero(count > 1)
    if len(more):
        k = back[more]
        t = np.floor(np.log(count[more].astype(np.float32))[:, None] / r[k] + b[k])
        value[more] = np.where(t == 0, once[k], c[k] - r[k] * (t - b[k]) - r[k])
    heads = runs(d)
    at = d[heads]
    best[at] = np.minimum(best[at], np.minimum.reduceat(value, heads, axis=0))


def signatures(texts: list[str]) -> np.ndarray:
    """One row of SAMPLES 16-bit places per text; a text without words has zeros."""
    raw = [t.encode("utf-8") for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offs[1:])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    s, e, d = words(buf, offs)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not len(s):
        return out
    h = span_hashes(buf, s, e)
    o = np.argsort(h)
    o = o[np.argsort(d[o].astype(np.uint16) if len(texts) < 65536 else d[o], kind="stable")]
    h, d = h[o], d[o]
    first = runs(d, h)
    count = np.diff(np.r_[first, len(h)])
    h, d = h[first], d[first]
    best = np.full((len(texts), SAMPLES), np.inf, np.float32)
    for lo in range(0, len(h), TERMS):  # a very long text's terms come in several slices
        _lower(best, h[lo:lo + TERMS], d[lo:lo + TERMS], count[lo:lo + TERMS])
    heads = runs(d)
    best = best[d[heads]]
    bits = mix64(best.view(np.uint32).astype(np.uint64) + _SEED[0])
    out[d[heads]] = (bits >> np.uint64(48)).astype(np.uint16)
    return out


def as_text(sig: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sig.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last third (floored) of the code points replaced by the next text's first as many."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows in descending doc_id order (null ids last; equal
    ids by text); the last one's is the first; a lone document follows itself.
    A null text is empty; an empty text's fingerprint is all zeros. Documents
    move once, to ranges of doc_id; the first document of each range goes to the
    range before as well, so no task needs another's rows. Other columns are
    not read; repeated rows keep a row each.
    """
    n = partitions(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = [-x for x in reversed(range_bounds(ids, "doc_id", n))]
    rank = F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf")))  # descending, null last
    bucket = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(float(x)) for x in cuts])
        bucket = F.size(F.filter(edges, lambda x: x <= F.col("rank")))
    heads = sorted((r["bucket"], r["head"]) for r in
                   ids.withColumn("rank", rank).withColumn("bucket", bucket).groupBy("bucket").agg(F.min("rank").alias("head")).collect())
    total = len(cuts) + 1
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # bounded: a row for each range

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(sorted(before))
        for b in batches:
            key = b.column(2).to_numpy()
            at = np.minimum(np.searchsorted(first, key), max(len(first) - 1, 0))
            lead = np.flatnonzero(first[at] == key) if len(first) else np.zeros(0, int)
            own = np.searchsorted(cuts, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.zeros(len(own), bool))], names=names)
            if len(lead):
                t = b.take(pa.array(lead))
                to = pa.array([before[k] for k in key[lead].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*t.columns, to, pa.array(np.ones(len(lead), bool))], names=names)

    names = ["doc_id", "text", "rank", "bucket", "ahead"]
    rows = src.withColumn("rank", rank).mapInArrow(spread, "doc_id long, text string, rank double, bucket int, ahead boolean")
    rows = rows.repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
              "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple[int, str, str]]) -> pa.RecordBatch:
            """``group``: (doc_id, text, next text); the texts follow one another."""
            new = [edited(t, f) for _, t, f in group]
            sig = signatures([t for _, t, _ in group] + [group[-1][2], *new])  # in one call: they share most terms
            own, nxt, new_sig = sig[:len(group)], sig[1:len(group) + 1], sig[len(group) + 1:]
            return pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in group], pa.int64()), pa.array([len(g[1]) for g in group], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in new]), pa.array(as_text(own)), pa.array(as_text(new_sig)),
                pa.array((own == new_sig).mean(1)), pa.array((own == nxt).mean(1))], names=list(fields))

        group, size, last, closed = [], 0, None, False
        for b in batches:
            for d, t, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                if closed:
                    continue  # equal ids lead the next range; only the first in order follows
                if last is not None:
                    group.append((*last, t))
                    size += len(t)
                last, closed = (d, t), ahead
                if size >= BATCH_CHARS:
                    yield made(group)
                    group, size = [], 0
        if group:
            yield made(group)

    return rows.mapInArrow(run, T.StructType([
        T.StructField(k, T.LongType() if v == pa.int64() else T.DoubleType() if v == pa.float64() else T.StringType()) for k, v in fields.items()]))
