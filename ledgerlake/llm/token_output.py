"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

The ids of the corpus are ranked by frequency (ties by id), so that frequent
ids have small ranks. A rank is stored in 1 to 4 little-endian bytes; the
length codes stand apart, four to a control byte. Blocks of documents, in
ascending doc_id order, are rows of a Parquet file set: ``bucket`` and
``first`` order the blocks, ``doc_id`` and ``n`` list the documents, ``control``
and ``data`` hold the codes. The rank table is a second Parquet file set.
Decoding is table lookup in NumPy: a control byte gives the total length of
its four codes and the place of each of their 16 bytes.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.chunks import BATCH_CHARS, TABLE, WORDS, ChunkTable, WordSplitter
from ledgerlake.llm.common import partitions, range_bounds, written
from ledgerlake.llm.textkit import flat, slices, tidy

BLOCK_IDS = 1 << 18


def id_type(vocabulary: str) -> str:
    """Little-endian width of an id on its way to the files: 2 bytes if all ids fit."""
    size = max(encoder(vocabulary).whole.get_vocab(True).values(), default=0)
    return "<u2" if size < 1 << 16 else "<u4"


class IdEncoder:
    """The tokenizers library, asked once for each distinct word.

    Special strings are cut out first and have their own id.
    """

    def __init__(self, path: str, table: int = TABLE, words: int = WORDS):
        from tokenizers import Tokenizer

        self.cut = WordSplitter(path)
        self.whole = Tokenizer.from_file(path)
        self.marker = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in self.cut.spec["added_tokens"]}
        self.cut.spec = None  # the parsed file is large and not needed again
        tokenize = self.whole.model.tokenize
        self.table = ChunkTable(lambda w: [t.id for t in tokenize(w)], self.cut.words, table, words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        parts, plans = [], []
        for t in texts:
            cut = self.cut.pieces(t)
            plans.append((len(parts), cut))
            parts += cut[::2]
        ids, ends = self.table.values(parts)
        ends = np.r_[0, ends]
        return [b"".join(self.marker[p] if k % 2 else ids[ends[at + k // 2]:ends[at + k // 2 + 1]].tobytes()
                         for k, p in enumerate(cut)) for at, cut in plans]


@functools.cache
def encoder(path: str, memo: tuple[int, int] = (TABLE, WORDS)) -> IdEncoder:
    """One encoder per Python worker and file."""
    return IdEncoder(path, *memo)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks below 2**32."""
    r = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    r[:len(ranks)] = ranks
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = (size - 1).reshape(-1, 4).astype(np.uint8)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    kept = np.arange(4) < size[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[kept].tobytes()


@functools.cache
def lookup() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: bytes of its four codes; the place of each of the
    16 output bytes among them (or past the longest, where a zero stands)."""
    size = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    start = np.cumsum(size, 1) - size
    place = start[:, :, None] + np.arange(4)
    place[np.arange(4) >= size[:, :, None]] = -1
    return size.sum(1), place.reshape(256, 16)


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ranks of a block."""
    total, place = lookup()
    c = np.frombuffer(control, np.uint8)
    raw = np.frombuffer(data + b"\0", np.uint8)
    at = np.cumsum(total[c]) - total[c]
    take = place[c]
    take = np.where(take < 0, len(raw) - 1, take + at[:, None])
    return np.ascontiguousarray(raw[take]).view("<u4").ravel()[:n]


def _encoded(docs: DataFrame, vocabulary: str, end_id: int | None, bounds: list[float], width: str, memo: tuple[int, int]) -> DataFrame:
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, memo)
        for whole in batches:
            for i, j in slices(flat(whole.column(1))[1], BATCH_CHARS):
                b = whole.slice(i, j - i)
                ids = [np.frombuffer(x + tail, "<u4").astype(width).tobytes() for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
                key = b.column(0).cast(pa.float64(), safe=False).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.searchsorted(bounds, key, "right").astype(np.int32)), pa.array(ids, pa.binary())],
                    names=["doc_id", "bucket", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, bucket int, ids binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """``pos``: row number in the bucket; a partition is one bucket, sorted (the low
    33 bits of the built-in id count a partition's rows)."""
    return rows.withColumn("pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def _frequencies(rows: DataFrame, width: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            buf, offs = flat(b.column(0))
            got = np.bincount(buf[offs[0]:offs[-1]].view(width))
            if len(got) > len(total):
                total = np.pad(total, (0, len(got) - len(total)))
            total[:len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, ranks, width: str) -> DataFrame:
    """Runs of consecutive documents of a bucket as coded blocks."""
    wide = np.dtype(width).itemsize

    def block(bucket: int, first: int, ids: list, docs: list) -> dict:
        flat = np.frombuffer(b"".join(ids), width)
        control, data = pack_ranks(ranks.value[flat])
        return {"bucket": bucket, "first": first, "doc_id": docs, "n": [len(x) // wide for x in ids], "control": control, "data": data}

    schema = "bucket int, first long, doc_id array<long>, n array<int>, control binary, data binary"
    arrow = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                       ("n", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, size, bucket, first = [], [], 0, -1, 0
        for b in batches:
            for d, k, x, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (k != bucket or p != first + len(ids) or size >= BLOCK_IDS):
                    yield pa.RecordBatch.from_pylist([block(bucket, first, ids, docs)], arrow)
                    ids, docs, size = [], [], 0
                if not ids:
                    bucket, first = k, p
                ids.append(x)
                docs.append(d)
                size += len(x) // wide
        if ids:
            yield pa.RecordBatch.from_pylist([block(bucket, first, ids, docs)], arrow)

    return rows.select("doc_id", "bucket", "ids", "pos").mapInArrow(run, schema)


def write_token_ids(docs: DataFrame, vocabulary: str, end_id: int | None = 1,
                    memo: tuple[int, int] = (TABLE, WORDS)) -> tuple[DataFrame, DataFrame]:
    """Encode every text and write the file sets into the shared folder. ``memo``
    bounds the chunks and the words that a worker remembers; no result depends on it.

    Returns (blocks, rank table) as read back from the files. A null text is
    empty (it still gets ``end_id``); a null doc_id sorts before all others;
    rows with equal doc_id keep one row each, ordered by their ids; columns
    other than doc_id and text are not read. Each document is tokenised once:
    its ids move to their doc_id range in one shuffle and are written, the
    frequencies are counted from there. The rank table is as long as the
    vocabulary at most, so it may be broadcast.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    bounds = range_bounds(docs, "doc_id", n)
    width = "<u4" if (end_id or 0) >= 1 << 16 else id_type(vocabulary)
    rows = _encoded(docs, vocabulary, end_id, bounds, width, memo)
    rows = _numbered(rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids"))
    rows = written(rows, "token-ids")
    table = written(_frequencies(rows, width).select("id", F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc("id"))).alias("place")), "token-ranks")
    of_id = {r["id"]: r["place"] - 1 for r in table.collect()}
    rank = np.zeros(max(of_id, default=0) + 1, np.uint32)
    rank[list(of_id)] = list(of_id.values())
    return written(_blocks(rows, spark.sparkContext.broadcast(rank), width), "token-blocks"), table


def read_token_ids(blocks: DataFrame, table: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of little-endian uint32 ids), and with ``keep_ids`` the
    ids as an array. Start offsets come from per-block sums: a window inside
    each bucket and one over the buckets (as many as shuffle partitions)."""
    spark = blocks.sparkSession
    places = {r["place"] - 1: r["id"] for r in table.collect()}
    ids = np.zeros(max(places, default=0) + 1, np.uint32)
    ids[list(places)] = list(places.values())
    shared = spark.sparkContext.broadcast(ids)
    sums = blocks.select("bucket", "first", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    inside = Window.partitionBy("bucket").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = sums.groupBy("bucket").agg(F.sum("size").alias("size")).select(
        "bucket", F.coalesce(F.sum("size").over(across), F.lit(0)).alias("base"))
    offset = sums.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(of_bucket, "bucket").select(
        "bucket", "first", (F.col("inside") + F.col("base")).alias("offset"))
    schema = "bucket int, first long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.asarray(r["n"], np.int64)
                end = np.cumsum(n)
                flat = shared.value[unpack_ranks(r["control"], r["data"], int(end[-1]))].astype("<u4")
                parts = [flat[e - k:e] for e, k in zip(end, n, strict=True)]
                cols = {"bucket": pa.array([r["bucket"]] * len(n), pa.int32()), "first": pa.array([r["first"]] * len(n), pa.int64()),
                        "doc_id": pa.array(r["doc_id"], pa.int64()), "within": pa.array(end - n), "n_tokens": pa.array(n),
                        "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                if keep_ids:
                    cols["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    out = blocks.mapInArrow(run, schema).join(offset, ["bucket", "first"])
    return out.select("doc_id", (F.col("within") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
                      *["ids"] * keep_ids)


def token_id_output(docs: DataFrame, vocabulary: str, end_id: int | None = 1, memo: tuple[int, int] = (TABLE, WORDS)) -> DataFrame:
    """Write the file sets and describe each document from what is read back."""
    return read_token_ids(*write_token_ids(docs, vocabulary, end_id, memo))
