"""Nearest vectors (X3): exact over all vectors, or over random-projection buckets.

Vectors travel packed: a chunk holds up to ``ROWS`` unit vectors of one length
and bucket as one binary value, a block up to ``BLOCK`` query vectors. Chunks
meet blocks by an equality join, each pair of them is one small matrix product
in an Arrow task that keeps k vectors a query, and only those go on to the
final ranking. Blocks are broadcast when their counted size is within
``broadcast_bytes``, so that vectors stay where they are; beyond it blocks are
copied to ``salts`` places over which the chunks are spread, by default as few as
leave about ``PIECE`` bytes of vectors of a bucket at each. Floats travel as they are
given. A task keeps k vectors a query over all of its chunks.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.columns import r6
from ledgerlake.operators.common import top_per_group

ROWS, BLOCK, PIECE = 1024, 128, 128 << 20
Keys = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _one_key(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield np.arange(len(unit)), np.zeros(len(unit), np.int64)


@functools.cache
def planes(tables: int, bits: int, length: int, seed: int) -> np.ndarray:
    """Random directions, ``bits`` of them a table."""
    return np.random.default_rng([seed, length]).standard_normal((tables, bits, length))


def _buckets(tables: int, bits: int, flips: int, seed: int) -> Keys:
    """A vector's bucket in each table (the sides of its planes it is on), and the
    buckets across each of the ``flips`` planes it is nearest to."""
    def keys(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = np.flatnonzero(np.isfinite(unit).all(1))
        for t, p in enumerate(planes(tables, bits, unit.shape[1], seed)):
            side = unit[rows] @ p.T
            own = (side >= 0) @ (1 << np.arange(bits)) + (t << bits)
            yield rows, own
            near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :flips]
            for j in range(near.shape[1]):
                yield rows, own ^ (1 << near[:, j])
    return keys


def _kind(df: DataFrame, vec: str) -> type:
    return np.float32 if df.schema[vec].dataType.elementType == T.FloatType() else np.float64


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _packed(df: DataFrame, id_col: str, vec: str, size: int, salts: int, keys: Keys) -> DataFrame:
    """Rows (length, key, salt, ids, vectors): vectors of one length and key, by id."""
    id_type, kind = df.schema[id_col].dataType, _kind(df, vec)
    schema = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))
            ids, lists = b.column(0), b.column(1)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]).astype(int).tolist():
                rows = np.flatnonzero(lengths == n)
                m = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                given = m.astype(kind)  # the numbers as they came
                for at, key in keys(_unit(m)):
                    order = np.argsort(key, kind="stable")
                    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]), len(order)] if len(order) else [0]
                    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                        for i in range(lo, hi, size):
                            part = at[order[i:min(i + size, hi)]]
                            blob = given[part].tobytes()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([n], pa.int32()), pa.array([int(key[order[i]])], pa.int64()),
                                 pa.array([(zlib.crc32(blob) + made) % salts], pa.int32()),
                                 pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(rows[part]))),
                                 pa.array([blob], pa.binary())], names=schema.names)
                            made += 1

    return df.select(F.col(id_col), F.col(vec).cast("array<double>").alias("_v")).mapInArrow(run, schema)


def _ranked(vectors: DataFrame, queries: DataFrame, k: int, names: tuple[str, str, str, str], vector_keys: Keys, query_keys: Keys,
            buckets: tuple[int, int, int], broadcast_bytes: int, salts: int | None) -> DataFrame:
    """``buckets``: number of keys, of keys of a vector and of a query."""
    query_id, query_vec, vec_id, vec = names
    number, own, copies = buckets
    size = queries.agg(F.sum(F.size(query_vec).cast("long"))).first()[0] or 0
    small = 8 * size * copies <= broadcast_bytes
    n = 1
    if not small:
        stored = (vectors.agg(F.sum(F.size(vec).cast("long"))).first()[0] or 0) * own * np.dtype(_kind(vectors, vec)).itemsize
        n = salts or max(-(-vectors.sparkSession.sparkContext.defaultParallelism // number), -(-stored // (number * PIECE)))
    chunks = _packed(vectors, vec_id, vec, ROWS, n, vector_keys)
    blocks = _packed(queries, query_id, query_vec, BLOCK, 1, query_keys).withColumn("block", F.monotonically_increasing_id()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .select("length", "key", "salt", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), "block")
    pairs = chunks.join(F.broadcast(blocks) if small else blocks, ["length", "key", "salt"])
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(vec_id, vectors.schema[vec_id].dataType),
                           T.StructField("score", T.DoubleType())])

    kinds = _kind(vectors, vec), _kind(queries, query_vec)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}  # block: its query ids, and for each of them the ids and scores of its best
        for b in batches:
            for i in range(b.num_rows):
                length, ids, qids, block = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(3)[i].values, b.column(5)[i].as_py()
                v, q = (_unit(np.frombuffer(b.column(c)[i].as_py(), t).astype(np.float64).reshape(-1, length)) for c, t in zip((2, 4), kinds, strict=True))
                s = np.einsum("ij,kj->ik", q, v)  # equal rows give equal scores, unlike a blocked product
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                found, scores = ids.take(pa.array(best.ravel())), np.take_along_axis(s, best, 1)
                if block in kept:
                    found, scores = _merged(kept[block][1:], (found, scores), k)
                kept[block] = kept[block][0] if block in kept else qids.take(pa.array(np.arange(len(q)))), found, scores
        for qids, found, scores in kept.values():
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(scores)), scores.shape[1]))), found,
                                              pa.array(scores.ravel(), from_pandas=True)], names=schema.names)

    return pairs.select("length", "ids", "vectors", "query_ids", "query_vectors", "block").mapInArrow(score, schema)


def _merged(a: tuple[pa.Array, np.ndarray], b: tuple[pa.Array, np.ndarray], k: int) -> tuple[pa.Array, np.ndarray]:
    """The k best of two lists of (ids, scores) per query: by score, then id."""
    ids, scores = pa.concat_arrays([a[0], b[0]]), np.hstack([a[1], b[1]])
    n, split = len(scores), a[1].size
    place = np.hstack([np.arange(split).reshape(n, -1), np.arange(split, split + b[1].size).reshape(n, -1)])
    by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[place]
    best = np.lexsort((by_id, -scores), axis=-1)[:, :k]
    return ids.take(pa.array(np.take_along_axis(place, best, 1).ravel())), np.take_along_axis(scores, best, 1)


def _final(scored: DataFrame, k: int, query_id: str, vec_id: str, salted: bool = True) -> DataFrame:
    top = top_per_group(scored, [query_id], [F.col("score").desc_nulls_last(), F.col(vec_id).asc()], k, salt_on=vec_id if salted else None, rank_col="rank")
    return top.select(query_id, vec_id, r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "query_vec",
                vec_id: str = "vec_id", vec: str = "embedding", broadcast_bytes: int = 32 << 20, salts: int | None = None) -> DataFrame:
    """The k vectors nearest (cosine) to every query vector, exactly, for any number of queries.

    Vectors without a direction (all zeros) have a null score and rank last;
    null, empty and partly null vectors and vectors of another length than the
    query's are no candidates. Equal scores rank by vec_id. Repeated rows stay
    repeated.
    """
    vectors, queries = (d.where(F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))) for d, c in ((vectors, vec), (queries, query_vec)))
    return _final(_ranked(vectors, queries, k, (query_id, query_vec, vec_id, vec), _one_key, _one_key, (1, 1, 1), broadcast_bytes, salts), k, query_id, vec_id)


def vector_topk_bucketed(vectors: DataFrame, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "query_vec",
                         vec_id: str = "vec_id", vec: str = "embedding", tables: int = 6, bits: int = 8, flips: int | None = None,
                         seed: int = 1, broadcast_bytes: int = 32 << 20, salts: int | None = None) -> DataFrame:
    """X3 for two large sides: like ``vector_topk``, but a query meets only vectors of its
    buckets. Of ``tables`` tables of ``bits`` random planes, every vector is in one
    bucket a table; a query looks into its own and, one plane at a time, across
    the ``flips`` (default: all) planes it is nearest to. All of a bucket is
    compared, whatever its size: its chunks are spread over ``salts`` places.
    Scores are exact, near vectors can be missed (more tables or fewer bits miss
    fewer); vectors without a direction have no bucket; a vec_id comes once a query.
    """
    flips = bits if flips is None else flips
    vectors, queries = (d.where(F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))) for d, c in ((vectors, vec), (queries, query_vec)))
    scored = _ranked(vectors, queries, k, (query_id, query_vec, vec_id, vec), _buckets(tables, bits, 0, seed), _buckets(tables, bits, flips, seed),
                     (tables << bits, tables, tables * (1 + flips)), broadcast_bytes, salts)
    # a query has at most k rows a task that met it: one shuffle by query serves the rest
    once = scored.repartition(query_id).groupBy(query_id, vec_id).agg(F.max("score").alias("score"))
    return _final(once, k, query_id, vec_id, salted=False)
