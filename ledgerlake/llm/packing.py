"""Best-fit packing by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Pieces that fill a
sequence alone need no search. The others are dealt at random into blocks of
about ``BLOCK_PIECES``; for each block, ``ISLANDS`` tasks evolve populations of
packings. Crossover takes whole well-filled bins of one parent into the other,
drops the other's bins that hold any of the same pieces, and puts their rest
back by best fit, largest first. After each epoch an island's best packing
moves to the next island of its block. The loosest bins of all blocks are then
opened, and their pieces packed again in new blocks, until one block is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.byte_chunks import byte_encoder
from ledgerlake.llm.common import written
from ledgerlake.llm.textkit import flat, release, slices

BLOCK_PIECES = 8192
ISLANDS, EPOCHS = 2, 2
POPULATION, OFFSPRING = 5, 8
#: Bins with more than this share of their room free are opened for the next level.
LOOSE = 1 / 64
BATCH_BYTES = 1 << 20


# ---------------------------------------------------------------- one block, in NumPy

def place_best_fit(lengths: list[int], free: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each length, in the given order, and the free space of all bins: each
    goes to the fullest bin that can take it, else to a new one. A bit for each
    amount of space that some bin has finds it in one step."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b in np.flatnonzero(free).tolist():
        room[free[b]].append(b)
        mask |= 1 << int(free[b])
    left, bins = free.tolist(), []
    for n in lengths:
        fits = mask >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                mask ^= 1 << f
        else:
            f, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        left[b] = f = f - n
        if f:
            room[f].append(b)
            mask |= 1 << f
    return np.array(bins, np.int32), np.array(left, np.int64)


def pack_all(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """A packing: the bin of each piece."""
    out = np.empty(len(lengths), np.int32)
    out[order] = place_best_fit(lengths[order].tolist(), np.zeros(0, np.int64), capacity)[0]
    return out


def fills(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def worth(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, int]:
    """Lower is better: bins, then less the squares of their fills."""
    f = fills(lengths, bins)
    return len(f), -int((f * f).sum())


def crossed(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with some of the well-filled bins of ``b``, and a few loose bins of ``a`` opened."""
    fa, fb = fills(lengths, a), fills(lengths, b)
    good = np.flatnonzero(fb >= np.quantile(fb, 0.5))
    taken = np.zeros(len(fb), bool)
    taken[rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.4))), replace=False)] = True
    injected = taken[b]
    gone = np.zeros(len(fa), bool)
    gone[a[injected]] = True
    loose = np.argsort(fa, kind="stable")[:max(2, len(fa) // 50)]
    gone[loose] = True
    gone[rng.integers(0, len(fa), max(1, len(fa) // 100))] = True
    kept = np.cumsum(~gone) - 1
    n = int((~gone).sum())
    out = np.where(injected, n + (np.cumsum(taken) - 1)[b], kept[a]).astype(np.int32)
    out[~injected & gone[a]] = -1
    moved = np.flatnonzero(out < 0)
    placed = out >= 0
    free = capacity - np.bincount(out[placed], lengths[placed], n + int(taken.sum())).astype(np.int64)
    moved = moved[np.argsort(-lengths[moved], kind="stable")]
    out[moved] = place_best_fit(lengths[moved].tolist(), free, capacity)[0]
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """The next population, best first. Ends early at the least number of bins that
    the total length allows."""
    rng = np.random.default_rng(seed)
    least = ceil(int(lengths.sum()) / capacity)
    if not population:
        population = [pack_all(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    while len(population) < POPULATION and population[0].max() + 1 > least:
        noise = lengths * rng.uniform(0.85, 1.15, len(lengths))
        population.append(pack_all(lengths, np.argsort(-noise, kind="stable"), capacity))
    rated = sorted(((worth(lengths, p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for step in range(OFFSPRING):
        if rated[0][0][0] <= least:
            break
        i, j = sorted(rng.choice(len(rated), 2, replace=False).tolist())
        child = crossed(lengths, rated[i][2], rated[j][2], capacity, rng)
        value = worth(lengths, child)
        if value < rated[-1][0] and all(value != x[0] for x in rated):
            rated[-1] = (value, len(population) + step, child)
            rated.sort(key=lambda x: x[:2])
    return [p for _, _, p in rated[:POPULATION]]


# ---------------------------------------------------------------- pieces

def pieces(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = 1024) -> DataFrame:
    """id (of the row), doc_id, piece, start, length, ids (little-endian binary, 2 or
    4 bytes an id by the vocabulary's size, see ``id_width``).

    A null text is empty (with ``end_id`` it still has one token; without one, a text
    without tokens is a piece of length 0). Repeated rows keep a row each; other
    columns are not read. Only texts of over ``capacity`` tokens are cut: the first
    piece takes the remainder, the others are full. Written once: the row ids stay.
    """
    width = id_width(vocabulary, end_id)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_encoder(vocabulary)
        for whole in batches:
            for i, j in slices(flat(whole.column(1))[1], BATCH_BYTES):
                b = whole.slice(i, j - i)
                cols: list[list] = [[], [], [], [], []]
                for d, x in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    x = np.concatenate([x, tail]).astype(width)
                    n = max(1, ceil(len(x) / capacity))
                    cuts = [0, *range(len(x) - (n - 1) * capacity, len(x), capacity), len(x)] if n > 1 else [0, len(x)]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for c, v in zip(cols, (d, k, lo, hi - lo, x[lo:hi].tobytes()), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        release()

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")
    return written(cut.select(F.monotonically_increasing_id().alias("id"), "*"), "pieces")


def id_width(vocabulary: str, end_id: int | None) -> str:
    most = max(byte_encoder(vocabulary).whole.get_vocab(True).values(), default=0)
    return "<u2" if max(most, end_id or 0) < 1 << 16 else "<u4"


# ---------------------------------------------------------------- islands

def _evolved(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Rows (block, island, lengths, population, elite) one epoch on. Packings stand
    one after the other, two bytes a piece."""
    arrow = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("lengths", pa.binary()), ("population", pa.binary()),
                       ("elite", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                own = [p for x in (r["population"], r["guest"]) if x for p in np.frombuffer(x, "<i4").reshape(-1, len(lengths))]
                got = evolve(lengths, own, capacity, zlib.crc32(f"{r['block']}:{r['island']}:{epoch}".encode()))
                yield pa.RecordBatch.from_pylist([{
                    "block": r["block"], "island": r["island"], "bins": int(got[0].max()) + 1, "lengths": r["lengths"],
                    "population": np.concatenate(got).astype("<i4").tobytes(), "elite": got[0].astype("<i4").tobytes()}], arrow)
        release()

    return state.select("block", "island", "lengths", "population", "guest").mapInArrow(
        run, "block long, island int, bins int, lengths binary, population binary, elite binary")


def pack_blocks(items: DataFrame, n_blocks: int, capacity: int, level: int) -> DataFrame:
    """(id, length, bin, offset, fill) of each piece (id, length), bins being numbers
    that are unique at this level. A block is dealt by a hash of the id, so its size stays
    close to its mean."""
    spark = items.sparkSession
    dealt = items.select("id", "length", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(n_blocks)).alias("block"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "id")))
    blocks = written(dealt.groupBy("block").agg(order.alias("x")).select(
        "block", F.transform("x", lambda x: x["id"]).alias("ids"), F.transform("x", lambda x: (-x["l"]).cast("int")).alias("lengths")), "blocks")

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.values.to_numpy().astype("<i4").tobytes()], pa.binary())], names=["block", "lengths"])

    none = F.lit(None).cast("binary")
    spread = max(1, min(n_blocks * ISLANDS, 10_000))
    state = blocks.select("block", "lengths").mapInArrow(as_bytes, "block long, lengths binary").select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), none.alias("population"), none.alias("guest"))
    ring = Window.partitionBy("block").orderBy("island")
    for epoch in range(EPOCHS):
        state = written(_evolved(state.repartition(spread, "block", "island"), capacity, epoch), "islands")
        if epoch + 1 < EPOCHS:  # the elite of each island visits the next one, the last island's the first
            last = F.last("elite").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            state = state.withColumn("guest", F.coalesce(F.lag("elite").over(ring), last))
    best = state.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))
    arrow = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, lengths, elite in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, bins = np.array(lengths, np.int64), np.frombuffer(elite, "<i4").astype(np.int64)
                o = np.argsort(bins, kind="stable")
                ends = np.cumsum(n[o])
                fill = fills(n, bins)
                offset = ends - n[o] - (np.cumsum(fill) - fill)[bins[o]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(ids, np.int64)[o], n[o], (block << 32) + bins[o], offset, fill[bins[o]])], schema=arrow)

    return written(blocks.join(best, "block").select("block", "ids", "lengths", "elite").mapInArrow(
        places, "id long, length long, bin long, offset long, fill long"), "places")


def assigned(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """(id, sequence_id, offset) for each piece (id unique, length from 1 to ``capacity``).

    Level by level: all but the loosest bins of a level are final, the pieces of the
    others meet in fewer blocks. Sequence numbers hold the level, the block and the bin.
    """
    done, left = [], items
    count, level = left.count(), 0
    while count:
        n_blocks = ceil(count / BLOCK_PIECES)
        packed = pack_blocks(left, n_blocks, capacity, level)
        number = F.lit(level << 56) + F.col("bin")
        loose = (capacity - F.col("fill")) > capacity * LOOSE
        left = packed.where(loose).select("id", "length")
        before, count = count, left.count() if n_blocks > 1 else 0
        if 2 * count > before:  # opening them again would not pay
            count = 0
        final = packed.where(~loose) if count else packed
        done.append(final.select("id", number.alias("sequence_id"), "offset"))
        level += 1
    if not done:
        return items.select("id", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return reduce(DataFrame.unionByName, done)


_PART = ["offset", "id", "doc_id", "piece", "start", "length"]


def sequences(parts: DataFrame, places: DataFrame, capacity: int) -> DataFrame:
    """The packed sequences in the shared folder: sequence_id, ids (binary as in
    ``parts``), parts array<struct<offset, id, doc_id, piece, start, length>>.

    A piece that fills a sequence is one as it lies in the files of ``parts`` and is not
    moved; the others meet by sequence and are written. A sequence has at most
    ``capacity`` pieces; pieces without tokens have no place in any.
    """
    alone = parts.where(F.col("length") >= capacity).withColumn("offset", F.lit(0).cast("long")).select(
        (-F.col("id") - 1).alias("sequence_id"), "ids", F.array(F.struct(*_PART)).alias("parts"))
    met = parts.where((F.col("length") > 0) & (F.col("length") < capacity)).join(places, "id").groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct(*_PART, "ids"))).alias("x"))
    return alone.unionByName(written(met.select(
        "sequence_id", F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("x", lambda p: F.struct(*[p[c].alias(c) for c in _PART])).alias("parts")), "sequences"))


def pack(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = 1024) -> DataFrame:
    """Pack whole documents; the sequences (see ``sequences``)."""
    parts = pieces(docs, vocabulary, end_id, capacity)
    open_ = parts.select("id", "length").where((F.col("length") > 0) & (F.col("length") < capacity))
    return sequences(parts, assigned(open_, capacity), capacity)


def described(packed: DataFrame, width: str) -> DataFrame:
    """One row per piece, read from the sequences: doc_id, piece, start, length,
    ids_crc32 (of its ids as little-endian uint32), sequence_id, offset."""
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                       ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for seq, ids, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(ids, width).astype("<u4")
                rows += [{k: p[k] for k in ("doc_id", "piece", "start", "length", "offset")} | {
                    "sequence_id": seq, "ids_crc32": zlib.crc32(x[p["offset"]:p["offset"] + p["length"]])} for p in parts]
            yield pa.RecordBatch.from_pylist(rows, arrow)
        release()

    return packed.select("sequence_id", "ids", "parts").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
