"""Helpers that the operators of this package share."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import ensure_checkpoint_dir, ship_package

# A word: a maximal run outside blank, tab, newline, VT, FF, CR.
NON_WORD = r"[\x20\x09-\x0D]+"


#: Arrow batches between Spark and the Python workers hold at most this much.
BATCH_ROWS, BATCH_LIMIT = 2_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """What each query of this package needs of its session: the package on the
    workers, and Arrow batches bounded in bytes (texts differ by orders of
    magnitude). A batch size that the user has lowered further stays."""
    ship_package(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_LIMIT)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        now = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``.

    Cuts the lineage: a lost executor costs the running stage only, and a
    table that several later steps read is computed once.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted and has at most ``rows`` rows;
    beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sums(df: DataFrame, group: list[str], order: list[Column], value: str, total_rows: int) -> DataFrame:
    """Add ``_before`` (sum of ``value`` over the rows before, by ``order``, in the
    group), ``_cell`` and ``_pos`` (row number in the cell), which together with
    the group name a row.

    ``df`` has a non-negative long ``_rank`` whose order is the first order.
    Rows of a group are dealt into cells by ``_rank`` ranges, about the square
    root of ``total_rows`` of them, so a hot group is summed by many tasks: one
    window inside each cell, one over the per-cell sums of a group. ``_rank``
    lies in [0, 2**40).
    """
    cells = max(1, math.isqrt(max(total_rows, 1)))
    df = df.withColumn("_cell", F.floor(F.col("_rank") * F.lit(cells) / F.lit(float(1 << 40))).cast("long"))
    sums = df.groupBy(*group, "_cell").agg(F.sum(value).alias("_cell_sum"))
    over = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_cell_before", F.coalesce(F.sum("_cell_sum").over(over), F.lit(0)).cast("long"))
    inner = Window.partitionBy(*group, "_cell").orderBy("_rank", *order)
    own = df.withColumn("_pos", F.row_number().over(inner)).withColumn(
        "_in_cell", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return (own.join(sums.drop("_cell_sum"), [*group, "_cell"])
               .withColumn("_before", F.col("_cell_before") + F.col("_in_cell"))
               .drop("_cell_before", "_in_cell"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (case aside)."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name += "_"
    return name


def fresh_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, lengthened until no column begins with it (case aside), so that any
    name made from it is new."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix += "_"
    return prefix


def range_bounds(df: DataFrame, col: str, n: int) -> list[float]:
    """At most n - 1 cut points that split the values of ``col`` about evenly
    (approximate quantiles; only the balance depends on them)."""
    qs = [i / n for i in range(1, n)]
    got = df.select(F.col(col).cast("double").alias("v")).approxQuantile("v", qs, 1 / (4 * n)) if qs else []
    return sorted(set(got))


FILTER_BITS = 24


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """Packed bits (2**24 of them, whatever the input) of the values of ``col``, each in
    [0, 2**24). As a broadcast prefilter it lets too much through, never too little."""
    one = F.col(col) + 1  # the SQL functions number bits from 1
    rows = (df.select(one.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit")).alias("at"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit"))).alias("bits"))).collect()
    full = np.zeros(1 << FILTER_BITS, bool)
    for r in rows:
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        full[on + (r["at"] - 1) * 32_768] = True
    return np.packbits(full, bitorder="little")


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.astype(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7) & 1 > 0
