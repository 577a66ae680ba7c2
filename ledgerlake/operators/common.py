"""Building blocks shared by the operators.

* ``period_spine``: calendar of every period between the first and the last
  observed one (pandas ``resample`` emits empty periods, ``groupBy`` does not).
* ``ordered_cumsum``: running sums over one global order without funnelling
  all rows through a single window task.
* ``top_per_group``: top-k rows per key in two rounds so a hot key is first
  reduced inside salted sub-groups.
* ``kpi_long``: one-row KPI frames to a long ``(metric, value)`` table.
"""

from __future__ import annotations

import uuid
from typing import Iterable, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.columns import PERIODS, col_of
from ledgerlake.session import ensure_checkpoint_dir


def period_spine(periods: DataFrame, col: str = "period", freq: str = "M") -> DataFrame:
    """All period starts from min(col) to max(col) of an already aggregated table.

    ``periods`` is small (one row per observed period), so the bounds agg and
    the ``sequence`` explode are cheap at any input size.
    """
    step = F.expr(f"INTERVAL {PERIODS[freq][1]}")
    bounds = periods.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return bounds.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", step)).alias(col))


def fill_spine(agg: DataFrame, col: str = "period", freq: str = "M",
               zero_cols: Sequence[str] = (), spine: DataFrame | None = None) -> DataFrame:
    """Left-join ``agg`` onto its calendar spine and zero-fill ``zero_cols``."""
    spine = spine if spine is not None else period_spine(agg, col, freq)
    out = spine.join(agg, col, "left")
    for c in zero_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(agg.schema[c].dataType)))
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared checkpoint folder:
    for an aggregated table that several passes of one query read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of ``spread`` gets on average.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as about ``rows`` rows need, so
    that a task's memory does not grow with the table; unlike the partitions of a plain
    shuffle, these are neither fixed in number nor merged. Groups, windows and joins
    by the keys (groups and windows also by more columns) follow without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, rows // 10_000), -(-rows // ROWS_A_TASK)), *keys)


def _order_exprs(order: Sequence) -> list[Column]:
    return [col_of(c) for c in order]


def ordered_cumsum(df: DataFrame, order: Sequence, values: dict[str, str],
                   partitions: int | None = None, grand_totals: bool = False) -> DataFrame:
    """Add inclusive running sums of ``values`` (out name -> input column)
    following the total order ``order`` (Columns or names, with asc/desc).

    Plan: range-partition on the order (a distributed sort, ties split by the
    trailing key columns, so no single value can pile into one task) ->
    sort within partitions -> reliable checkpoint (stable partition ids,
    survives executor loss) -> per-partition prefix sums in one Arrow pass ->
    per-partition totals (one row per partition) -> exclusive offsets on that
    tiny table -> broadcast join on the partition id. The broadcast side has
    exactly one row per range partition, a bound fixed by ``partitions``.
    ``grand_totals`` also adds ``<out>_grand``, the sum over all rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oexprs = _order_exprs(order)
    # The range partitioner samples its input in a job of its own; keeping
    # the (already aggregated) input for the sample and the shuffle avoids
    # computing it twice. MEMORY_AND_DISK: a lost block is recomputed.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = (src.repartitionByRange(n, *oexprs)
                 .sortWithinPartitions(*oexprs)
                 .withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)
    src.unpersist()

    loc_names = {out: f"_loc_{out}" for out in values}
    schema = T.StructType(ranged.schema.fields + [
        T.StructField(loc_names[o], T.DoubleType(), True) for o in values])

    def scan(batches):
        carry = {o: 0.0 for o in values}
        for pdf in batches:
            for o, src in values.items():
                v = pd.to_numeric(pdf[src], errors="coerce").fillna(0.0).astype("float64")
                cs = v.cumsum() + carry[o]
                if len(cs):
                    carry[o] = float(cs.iloc[-1])
                pdf[loc_names[o]] = cs
            yield pdf

    local = ranged.mapInPandas(scan, schema)
    totals = ranged.groupBy("_pid").agg(*[
        F.sum(F.coalesce(F.col(src).cast("double"), F.lit(0.0))).alias(f"_tot_{o}")
        for o, src in values.items()])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[
        F.coalesce(F.sum(f"_tot_{o}").over(w), F.lit(0.0)).alias(f"_off_{o}") for o in values],
        *[F.sum(f"_tot_{o}").over(Window.partitionBy()).alias(f"{o}_grand") for o in values])
    out = local.join(F.broadcast(offsets), "_pid", "left")
    for o in values:
        out = out.withColumn(o, F.col(loc_names[o]) + F.col(f"_off_{o}"))
    out = out.drop("_pid", *loc_names.values(), *[f"_off_{o}" for o in values])
    if not grand_totals:
        out = out.drop(*[f"{o}_grand" for o in values])
    return out


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                  salt_buckets: int = 64, salt_on: str | None = None,
                  rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows per ``keys`` under ``order``.

    Round 1 ranks inside ``(keys, hash(salt_on) % salt_buckets)`` and keeps k
    rows per salted sub-group; round 2 ranks the at most ``k*salt_buckets``
    survivors per key. A key holding a third of the rows is thus spread over
    ``salt_buckets`` tasks before the final, bounded window.
    """
    oexprs = _order_exprs(order)
    keys = list(keys)
    if salt_on is not None and salt_buckets > 1:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salt_buckets)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*oexprs)
        df = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k) \
                   .drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*oexprs) if keys else Window.orderBy(*oexprs)
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def kpi_long(df: DataFrame, metrics: Iterable[str] | None = None,
             name: str = "metric", value: str = "value") -> DataFrame:
    """Wide one-row (or few-row) KPI frame -> long (metric, value double)."""
    cols = list(metrics) if metrics is not None else df.columns
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot([], cols, name, value)
