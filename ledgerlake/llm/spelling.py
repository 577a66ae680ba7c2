"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted with map-side sums. The vocabulary's hashes go into blocked
Bloom filters, one shard per word length, whose pages are built by the tasks
and broadcast. Every word then generates its edits (all deletions, and all
replacements by a later letter: the other half of the near relation is the
same pairs seen from their other word) as hashes, in NumPy and without any
string, and probes the filters. Only hits become strings and shuffle to an exact
join with the vocabulary, which removes the false ones.

A broadcast holds at most ``PAGES`` pages of 4 KB. The pages of all shards
stand in one virtual row; a vocabulary that needs more is probed in several
rounds, each with the next ``PAGES`` of them and the words that reach them, so
filters keep their density at every size.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import partitions, written
from ledgerlake.llm.textkit import flat, mix64, release, runs, span_hashes

MIN_LENGTH, MIN_COUNT, NOISE = 5, 3, 97
#: Filter density, pages of a broadcast (32 MB), and the length from which words share a shard.
BITS_PER_WORD, PAGES, LONG = 16, 8192, 64
PAGE_BYTES, LANES = 4096, 8
PAGE_BLOCKS = PAGE_BYTES // (8 * LANES)
PIECE, FLUSH, PROBES = 1 << 20, 100_000, 1 << 18

_RUN = np.zeros(256, bool)
_RUN[[*range(65, 91), *range(97, 123), 0xC3]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_SHORT = 48


# ---------------------------------------------------------------- words of texts

def letter_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (as
    UTF-8: the byte C3 and the one after it)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _RUN[buf]
    inside[1:] |= buf[:-1] == 0xC3
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True  # no run crosses a row
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]])
    ends = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, "right")


@functools.cache
def _zeros(length: int) -> np.ndarray:
    """What ``length`` zero bytes make of each byte of a CRC-32 register: 4 x 256."""
    step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    out = np.empty((4, 256), np.uint32)
    for k in range(4):
        reg = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(length):
            reg = step[reg & 255] ^ (reg >> np.uint32(8))
        out[k] = reg
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row, from their own CRCs and the second's length
    (below ``_SHORT``)."""
    table = np.stack([_zeros(i) for i in range(_SHORT)])
    out = second.astype(np.uint32)
    for k in range(4):
        out ^= table[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def noisy(word: str, h: int) -> str:
    i = h % len(word)
    return word[:i] + word[i + 1:]


def pieces(texts: pa.Array, rows: list[bytes], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in buffers of about ``limit`` bytes; a longer text is cut beside a byte
    that no run holds (a run longer than that stays whole)."""
    buf, offs = flat(texts)
    part, at, who, size = [], [0], [], 0
    for i, row in enumerate(rows):
        a, end = int(offs[i]), int(offs[i + 1])
        while True:
            b = min(end, a + limit)
            while b < end:
                free = np.flatnonzero(~(_RUN[buf[b:b + limit]] | (buf[b - 1:b - 1 + len(buf[b:b + limit])] == 0xC3)))
                free = free[free < end - b]
                if len(free):
                    b += int(free[0])
                    break
                b = min(end, b + limit)
            part.append(buf[a:b])
            size += b - a
            at.append(size)
            who.append(row)
            if size >= limit:
                yield np.concatenate(part), np.array(at), who
                part, at, who, size = [], [0], [], 0
            a = b
            if a >= end:
                break
    if part:
        yield np.concatenate(part), np.array(at), who


def piece_counts(buf: np.ndarray, offs: np.ndarray, ids: list[bytes], into: dict[bytes, int]) -> None:
    """Add the words of the texts in ``buf`` to ``into`` (UTF-8, lower-cased: count)."""
    s, e, d = letter_runs(buf, offs)
    if not len(s):
        return
    marks = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = marks[e] - marks[s] >= MIN_LENGTH
    s, e, d = s[long], e[long], d[long]
    if not len(s):
        return
    h = span_hashes(buf, s, e)
    o = np.argsort(h)
    heads = runs(h[o])
    kind = np.empty(len(h), np.int64)
    kind[o] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(h)]))
    raw = buf.tobytes()
    words = [raw[a:b].lower() for a, b in zip(s[o[heads]].tolist(), e[o[heads]].tolist(), strict=True)]  # bytes: A-Z only
    before = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    crc = joined_crc(before[d], alone[kind], np.minimum(size, _SHORT - 1)[kind])
    for i in np.flatnonzero(size[kind] >= _SHORT).tolist():
        crc[i] = zlib.crc32(words[kind[i]], int(before[d[i]]))
    odd = crc % NOISE == 0
    n = np.bincount(kind[~odd], minlength=len(words))
    for w, k in zip(words, n.tolist(), strict=True):
        if k:
            into[w] = into.get(w, 0) + k
    for k, c in zip(kind[odd].tolist(), crc[odd].tolist(), strict=True):
        w = noisy(words[k].decode(), c)
        if len(w) >= MIN_LENGTH:
            w = w.encode()
            into[w] = into.get(w, 0) + 1


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts with at least ``MIN_COUNT`` occurrences.

    A null text has no words, a null doc_id is written as nothing in the CRC's
    string. Tasks add up in a table that is emptied at ``FLUSH`` words, Spark adds
    up the rest, first on the map side.
    """
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])
    piece, flush = PIECE, FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            keys = pa.array(list(total), pa.binary()).cast(pa.string())
            got = pa.RecordBatch.from_arrays([keys, pa.array(list(total.values()), pa.int64())], schema=arrow)
            total.clear()
            return got

        for b in batches:
            ids = [str(i).encode() if i is not None else b"" for i in b.column(0).to_pylist()]
            for part in pieces(b.column(1), ids, piece):
                piece_counts(*part, total)
                if len(total) >= flush:
                    yield out()
        if total:
            yield out()
        release()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- hashes of words and edits

def as_letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point (all are below U+0100), and offsets."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offs[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offs


@functools.lru_cache(1)
def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int) -> np.ndarray:
    return _powers(max(64, 1 << n.bit_length()))


def mixed(h: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix64(h + np.asarray(length, np.uint64) * _LENGTH)


class Shards:
    """Where the filters of each length stand in the virtual row of pages."""

    def __init__(self, counts: dict[int, int]):
        self.long = LONG
        self.first, self.pages = np.zeros(LONG + 1, np.int64), np.zeros(LONG + 1, np.uint64)
        at = 0
        for length in range(LONG + 1):
            self.first[length] = at
            self.pages[length] = n = ceil(counts.get(length, 0) * BITS_PER_WORD / (8 * PAGE_BYTES))
            at += n
        self.total = at

    def page(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Virtual page of each hash, -1 where no word has that length."""
        shard = np.minimum(length, self.long)
        n = self.pages[shard]
        own = (h * _BASE >> np.uint64(32)) % np.maximum(n, np.uint64(1))
        return np.where(n > 0, self.first[shard] + own.astype(np.int64), -1)


def block_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64) % PAGE_BLOCKS  # the lanes use the 48 bits below


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    return np.uint64(1) << ((h >> np.uint64(6 * lane)) & np.uint64(63))


def whole_hashes(letters: np.ndarray, offs: np.ndarray) -> np.ndarray:
    p = powers(int(np.diff(offs).max(initial=0)) + 1)
    size = np.diff(offs)
    term = (letters + np.uint64(1)) * p[np.arange(len(letters)) - np.repeat(offs[:-1], size)]
    total = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
    return total[offs[1:]] - total[offs[:-1]]


def filter_pages(words: DataFrame, shards: Shards) -> DataFrame:
    """(page, bits) of the filters: each word's block lies in one page, so words move
    to their page's task, which holds pages only (all of them are bounded by rounds)."""
    arrow = pa.schema([("page", pa.int64()), ("h", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters, offs = as_letters(b.column(0))
            size = np.diff(offs)
            h = mixed(whole_hashes(letters, offs), size)
            yield pa.RecordBatch.from_arrays([pa.array(shards.page(h, size)), pa.array(h.view(np.int64))], schema=arrow)

    pages = pa.schema([("page", pa.int64()), ("bits", pa.binary())])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(0, np.uint64)
        for b in batches:
            page, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for i, j in zip(starts := runs(page), [*starts[1:], len(page)], strict=True):
                if page[i] != now:
                    if now >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()], pa.binary())], schema=pages)
                    now, bits = int(page[i]), np.zeros(PAGE_BYTES // 8, np.uint64)
                block = block_of(h[i:j]) * LANES
                for lane in range(LANES):
                    np.bitwise_or.at(bits, block + lane, lane_bit(h[i:j], lane))
        if now >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()], pa.binary())], schema=pages)

    return words.select("word").mapInArrow(hashed, "page long, h long").repartition(
        partitions(words.sparkSession), "page").sortWithinPartitions("page").mapInArrow(built, "page long, bits binary")


class Filters:
    """A round's pages: ``low`` to ``low`` + len(bits) of the virtual row."""

    def __init__(self, shards: Shards, low: int, bits: np.ndarray):
        self.shards, self.low, self.bits = shards, low, bits

    def hits(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the probes that may be words; lanes are looked up while they last."""
        page = self.shards.page(h, length) - self.low
        on = np.flatnonzero((page >= 0) & (page < len(self.bits)))
        h, page = h[on], page[on]
        at = page * (PAGE_BLOCKS * LANES) + block_of(h) * LANES
        flat_bits = self.bits.reshape(-1)
        for lane in range(LANES):
            ok = flat_bits[at + lane] & lane_bit(h, lane) != 0
            on, h, at = on[ok], h[ok], at[ok]
        return on


def probes(letters: np.ndarray, offs: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, place, letter) of the edits that the filters let through; letter -1
    deletes. Deletions of a run of one letter are generated once."""
    size = np.diff(offs)
    p = powers(int(size.max(initial=0)) + 1)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - offs[word]
    term = (letters + np.uint64(1)) * p[place]
    total = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
    whole = (total[offs[1:]] - total[offs[:-1]])[word]
    before = total[:-1] - total[offs[:-1]][word]
    last = np.ones(len(letters), bool)
    last[:-1] = (letters[:-1] != letters[1:]) | (word[:-1] != word[1:])
    at = np.flatnonzero(last & (size[word] > 1))
    h = before[at] + (whole[at] - before[at] - term[at]) * _INVERSE
    got = at[filters.hits(mixed(h, size[word[at]] - 1), size[word[at]] - 1)]
    yield word[got], place[got], np.full(len(got), -1)
    for a in alphabet.tolist():
        at = np.flatnonzero(letters < a)
        h = whole[at] + (np.uint64(a) - letters[at]) * p[place[at]]
        got = at[filters.hits(mixed(h, size[word[at]]), size[word[at]])]
        yield word[got], place[got], np.full(len(got), a)


def candidates(words: DataFrame, shards: Shards, alphabet: np.ndarray, low: int, pages: np.ndarray) -> DataFrame:
    """(word, n, other) whose ``other`` the round's filters hold, right or not."""
    shared = words.sparkSession.sparkContext.broadcast((shards, low, pages))
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string())])
    most = PROBES // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*shared.value)
        for whole in batches:
            letters, offs = as_letters(whole.column(0))
            i = 0
            while i < whole.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
                b = whole.slice(i, j - i)
                names = [w.encode("latin-1") for w in b.column(0).to_pylist()]
                n = b.column(1).to_numpy()
                for w, p, a in probes(letters[offs[i]:offs[j]], offs[i:j + 1] - offs[i], alphabet, filters):
                    other = [(names[k][:x] + (bytes([c]) if c >= 0 else b"") + names[k][x + 1:]).decode("latin-1")
                             for k, x, c in zip(w.tolist(), p.tolist(), a.tolist(), strict=True)]
                    if other:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w)), pa.array(n[w]), pa.array(other)], schema=arrow)
                i = j
        release()

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, m): each pair of near words once. ``words``: a written table
    (word, n) of distinct words."""
    spark = words.sparkSession
    size = F.least(F.char_length("word"), F.lit(LONG))
    counts = {r["size"]: r["n"] for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    seen = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).groupBy("c").count().collect()  # 90 letters at most
    alphabet = np.array(sorted(r["c"].encode("latin-1")[0] for r in seen if r["c"]), np.int64)
    shards = Shards(counts)
    pages = written(filter_pages(words, shards), "filter-pages") if shards.total else None
    rounds = []
    for low in range(0, shards.total, PAGES):
        n = min(PAGES, shards.total - low)
        bits = np.zeros((n, PAGE_BLOCKS * LANES), np.uint64)
        for r in pages.where(F.col("page").between(low, low + n - 1)).toLocalIterator():
            bits[r["page"] - low] = np.frombuffer(bytes(r["bits"]), np.uint64)
        hit = [k for k in range(LONG + 1) if shards.pages[k] and shards.first[k] < low + n and shards.first[k] + int(shards.pages[k]) > low]
        reach = words.where(size.isin([*hit, *(min(k + 1, LONG) for k in hit)]))
        rounds.append(candidates(reach, shards, alphabet, low, bits))
    if not rounds:
        return words.sparkSession.createDataFrame([], "word string, n long, other string, m long")
    found = functools.reduce(DataFrame.unionByName, rounds)
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").select("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling. ``forms``:
    a written table (word, form). Counts at least double along a chain, so it has at
    most 63 steps and the rounds at most six."""
    now = forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done"))
    while True:
        open_ = now.where(~F.col("done"))
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("end"))
        step = open_.select("word", "root").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), (F.col("next").isNull() | F.col("end")).alias("done"))
        now = written(now.where("done").unionByName(step), "roots")
        if now.where(~F.col("done")).isEmpty():
            return now.select("word", "root")


def spelling_forms(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs`` (doc_id, text).

    Near words differ by one inserted, deleted or replaced code point. The form
    is the near word of largest n (ties: least in code-point order) if its n is
    at least twice the word's, else null; the root is the end of the chain of forms.
    Texts without letters give nothing, an empty table an empty result; repeated
    rows count each time; other columns are not read. A word has at most 90 near
    words a place, so no group is hot; neither words nor pairs go to the driver.
    """
    words = written(vocabulary(docs), "vocabulary")
    pairs = written(near_pairs(words), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    chosen = -F.col("best.m") >= 2 * F.col("n")
    named = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"),
        F.when(chosen, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(named.where("form is not null").select("word", "form"))
    out = named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return out.select(*[F.col(c).cast(T.StringType() if c in ("word", "form", "root") else T.LongType()) for c in out.columns])
