"""Vectorised NumPy helpers over a batch of texts, used inside Spark tasks.

A batch of texts is one byte buffer plus row offsets (Arrow's own layout), so
words, hashes and shingles of thousands of documents cost a handful of array
passes. Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; letters
A-Z are lower-cased before hashing. Hashes have 64 bits and mix the word
length in; two different words or shingles meet with probability 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLOT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                  0x589965CC75374CC3], dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0]:o[-1]], o - o[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span, A-Z lower-cased unless told otherwise."""
    up, down = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    byte = _LOWER[buf] if lower else buf.astype(np.uint64)
    np.cumsum((byte + np.uint64(1)) * up[:len(buf)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _SLOT[0]))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses a row border."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = _IS_WORD[buf]
    full = offs[:-1][offs[1:] > offs[:-1]]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[full] = False
    after = np.empty_like(w)
    after[:-1] = w[1:]
    after[last] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, "right")


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word ``k``-shingles of every row as (hash, row), sorted by row and hash.

    A row with fewer than ``k`` words has its whole sequence as one shingle, a
    row without words none.
    """
    s, e, d = words(buf, offs)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wh = span_hashes(buf, s, e)
    per = np.bincount(d, minlength=len(offs) - 1)
    parts_h, parts_d = [], []
    if len(s) >= k:
        n = len(s) - k + 1
        same = d[:n] == d[k - 1:]
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += wh[j:j + n] * _SLOT[j % 5] * np.uint64(1 + 2 * (j // 5))
        parts_h.append(mix64(h[same]))
        parts_d.append(d[:n][same])
    short = per[d] < k
    if short.any():
        sh, sd = wh[short], d[short]
        first = np.flatnonzero(np.r_[True, sd[1:] != sd[:-1]])
        place = np.arange(len(sd)) - np.repeat(first, np.diff(np.r_[first, len(sd)]))
        t = sh * _SLOT[place % 5] * (np.uint64(1) + np.uint64(2) * (place // 5).astype(np.uint64))
        rows = sd[first]
        parts_h.append(mix64(np.add.reduceat(t, first) + per[rows].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        parts_d.append(rows)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    o = np.argsort(h)
    h, d = h[o], d[o]
    o = np.argsort(d.astype(np.uint16) if len(offs) < 65536 else d, kind="stable")
    h, d = h[o], d[o]
    keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    return h[keep], d[keep]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal key tuples; the keys are sorted."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand free memory back, Arrow's and the C library's, and let the powers of a very
    long text go, so that an idle worker keeps little."""
    if len(_POW["up"]) > SLICE_BYTES + 1:
        _POW.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's function that ends with ``release``."""
    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def pack(batch: pa.RecordBatch) -> bytes:
    """A record batch as one compressed Arrow stream, the unit of a packed exchange."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def pack_buckets(bucket: np.ndarray, cols: dict[str, np.ndarray], n: int) -> tuple[list[int], list[bytes]]:
    """Rows split by bucket, each bucket's rows packed."""
    o = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
    edges = np.searchsorted(bucket[o], np.arange(n + 1))
    cols = {k: v[o] for k, v in cols.items()}
    ids, blobs = [], []
    for b in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[b], edges[b + 1]
        ids.append(int(b))
        blobs.append(pack(pa.record_batch({k: pa.array(v[lo:hi]) for k, v in cols.items()})))
    return ids, blobs
