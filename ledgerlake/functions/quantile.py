"""Exact quantiles of columns of any size, without gathering their values.

Two aggregations over the input, both of which combine on the map side:

1. a sketch gives two edges around each wanted place (``percentile_approx``),
   four times as far apart as its error bound allows the place to lie;
2. rows are counted by value between the edges of a place (a hot value is one
   row), and without their value elsewhere; a column of at most ``FEW`` values
   keeps them all. The running count over the value ranges and the kept values
   gives the order statistics, which are interpolated linearly as pandas does.

Of a column, at most ``FEW`` or 8 / ``SKETCH`` of its rows keep their value for
each place; only the distinct ones of these meet in the window of the running
count. Should the sketch ever miss its bound, the query fails; it is never wrong.
A table that is counted and has at most ``FEW`` rows takes the built-in exact
aggregate instead: the same answer from a bounded buffer, in fewer stages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch, and the number of rows that may meet in one task.
SKETCH = 10_000
FEW = 500_000


def _edges(c: str, ps: Sequence[float]) -> Column:
    near = [min(1.0, max(0.0, p + d)) for p in ps for d in (-4 / SKETCH, 4 / SKETCH)]
    return F.percentile_approx(_number(c), F.array(*[F.lit(x) for x in near]), F.lit(SKETCH))


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _ranged(long: DataFrame, n: int) -> DataFrame:
    """With ``range``, the number of the value range of ``v`` (it rises at each edge of
    ``e``, never falls), and ``v`` left out unless between the edges of a place."""
    v, e = F.col("v"), F.col("e")
    at = [(v >= e[2 * i], v > e[2 * i + 1]) for i in range(n)]
    number = sum((low.cast("int") + high.cast("int") for low, high in at), F.lit(0))
    return long.withColumns({"range": number, "v": F.when(_any([F.col("few"), *[low & ~high for low, high in at]]), v)})


def quantile_table(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q): per group and numeric column its number of values and
    the quantiles ``ps`` as an array<double>. Null and NaN are no values; a group
    without values has no row. Null keys form a group."""
    by, k = list(by), len(ps)
    if df.limit(FEW + 1).count() <= FEW:
        each = [F.struct(F.lit(c).alias("column"), F.count(_number(c)).alias("n"), F.percentile(_number(c), F.array(*[F.lit(float(p)) for p in ps])).alias("q"))
                for c in columns]
        return df.groupBy(*by).agg(F.array(*each).alias("_a")).select(*by, F.inline("_a")).where("n > 0")
    edges = [F.struct(*[x for i, c in enumerate(columns) for x in (_edges(c, ps).alias(f"e{i}"), (F.count(_number(c)) <= FEW).alias(f"few{i}"))]).alias("_e")]
    if by:
        names = [f"_by{i}" for i in range(len(by))]
        of_group = df.groupBy(*by).agg(*edges).withColumnsRenamed(dict(zip(by, names, strict=True)))
        df = df.join(of_group, [df[b].eqNullSafe(of_group[n]) for b, n in zip(by, names, strict=True)])
    else:
        df = df.withColumn("_e", df.agg(*edges).scalar())  # a column, so that it is planned once
    long = df.select(*[F.col(b) for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _number(c).alias("v"), F.col(f"_e.e{i}").alias("e"), F.col(f"_e.few{i}").alias("few"))
        for i, c in enumerate(columns)]))).where(F.col("v").isNotNull())
    key = [*by, "column"]
    counted = _ranged(long, k).groupBy(*key, "range", "v").agg(F.count("*").alias("m"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("range", "v").rowsBetween(Window.unboundedPreceding, -1)
    at = counted.withColumns({"before": F.coalesce(F.sum("m").over(upto), F.lit(0)), "n": F.sum("m").over(whole)})
    ends = F.col("before") + F.col("m")
    found = []
    for i, p in enumerate(ps):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for name, r in ((f"low{i}", F.floor(place)), (f"high{i}", F.ceil(place))):
            found.append(F.max(F.when((r >= F.col("before")) & (r < ends), F.col("v"))).alias(name))
    got = at.groupBy(*key, "n").agg(*found)
    missed = F.raise_error(F.lit("quantile sketch outside its error bound")).cast("double")
    q = []
    for i, p in enumerate(ps):
        place, low, high = F.lit(float(p)) * (F.col("n") - 1), F.col(f"low{i}"), F.col(f"high{i}")
        part = place - F.floor(place)
        q.append(F.when(low.isNull() | high.isNull(), missed).when(part == 0, low).otherwise((1 - part) * low + part * high))
    return got.select(*key, "n", F.array(*q).alias("q"))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def quantiles_of(df: DataFrame, columns: Sequence[str], ps: Sequence[float]) -> Column:
    """The quantiles of whole columns as a scalar subquery: a struct with an
    array<double> for each column (null where it has no value)."""
    t = quantile_table(df, columns, ps)
    return t.agg(*[F.first(F.when(F.col("column") == c, F.col("q")), ignorenulls=True).alias(c) for c in columns]).select(
        F.struct(*columns)).scalar()
