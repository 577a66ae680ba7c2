"""Cleaning, projection, validation and profiling.

All row rules are Column expressions (one projection or filter each);
profiles and quality checks are single aggregations.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.columns import clean_amount, r6
from ledgerlake.functions.quantile import quantiles_of

# Fixed value: the default cut-off of old orders.
DEFAULT_MIN_DATE = "2021-03-31"


def standardize_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def snake_case_columns(df: DataFrame, drop: Sequence[str] = ("group_price",)) -> DataFrame:
    """Lower-case names, blanks -> '_', then drop listed columns."""
    out = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return out.drop(*[c for c in drop if c in out.columns])


def clean_amount_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Amount text -> double (currency signs, NBSP and blanks removed,
    decimal comma); unparsable -> null."""
    return df.withColumn(out or col, clean_amount(col))


def amount_conversion_report(df: DataFrame, raw: str, cleaned: str) -> DataFrame:
    """P3 report: non-null values before and after conversion, in one agg."""
    return df.agg(F.count(raw).alias("original_non_null"), F.count(cleaned).alias("converted_non_null"))


def clean_retail_amount(c) -> F.Column:
    """P4 expression: keep the text before '(' then clean as P3 ('12,00€(x)' -> 12.0)."""
    return clean_amount(F.substring_index(F.col(c) if isinstance(c, str) else c, "(", 1))


def clean_retail_amounts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Apply ``clean_retail_amount`` to each listed column."""
    for c in cols:
        df = df.withColumn(c, clean_retail_amount(c))
    return df


def parse_date(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """P5: coerce to timestamp (``fmt`` e.g. 'd MMM yyyy'), dropping rows
    that fail to parse."""
    ts = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.col(col).try_cast("timestamp")
    return df.withColumn(col, ts.cast("timestamp_ntz")).where(F.col(col).isNotNull())


def exclude_clients(df: DataFrame, excluded, client: str = "client") -> DataFrame:
    """Drop rows of the listed clients; rows with a null client stay.

    ``excluded`` is a Python list (inlined as an IN list) or a DataFrame with
    a ``client`` column (left anti join; Spark broadcasts it only if its
    measured size is under the threshold)."""
    if isinstance(excluded, DataFrame):
        ex = excluded.select(F.col(client).alias("_ex")).where(F.col("_ex").isNotNull())
        kept = df.join(ex, df[client] == ex["_ex"], "left_anti")
        return kept
    return df.where(~F.coalesce(F.col(client).isin(list(excluded)), F.lit(False)))


def filter_min_date(df: DataFrame, cutoff: str = DEFAULT_MIN_DATE, date: str = "date") -> DataFrame:
    """Keep rows on or after the cut-off (pushed down to the scan)."""
    return df.where(F.col(date) >= F.lit(cutoff).cast("timestamp_ntz"))


def drop_empty_carts(carts: DataFrame, marker: str, cart_id: str = "order_ref",
                     total: str = "total") -> DataFrame:
    """Drop carts that carry the abandoned marker and a zero total."""
    cond = (F.col(cart_id) == marker) & (F.col(total) == 0)
    return carts.where(~F.coalesce(cond, F.lit(False)))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any required column."""
    return df.dropna(subset=list(required))


def fill_unknown(df: DataFrame, text_cols: Sequence[str] = ("client", "carrier"),
                 numeric_cols: Sequence[str] = ()) -> DataFrame:
    """P10: text columns -> 'Unknown', numeric columns -> 0 where null."""
    out = df.fillna("Unknown", subset=[c for c in text_cols if c in df.columns])
    if numeric_cols:
        out = out.fillna(0, subset=list(numeric_cols))
    return out


def dedup_by_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key tuple: the smallest under ``order`` (default: the
    remaining columns in their order), i.e. a deterministic 'first'.

    Written as ``min(struct(order..., row...))`` grouped by the keys: a
    plain aggregation with map-side partial results, so a key shared by a
    third of the table is reduced on every executor before the shuffle
    instead of being sorted in one window task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = list(order) if order is not None else rest
    fields = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)] + \
             [F.col(c).alias(f"_v_{c}") for c in rest]
    g = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_m"))
    return g.select(*[F.col(c) for c in df.columns if c in keys] +
                    [F.col(f"_m._v_{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_exact(df: DataFrame) -> DataFrame:
    """Drop fully identical rows."""
    return df.distinct()


def validate_rows(df: DataFrame, rules: Sequence[tuple[str, F.Column]], key: str = "id") -> DataFrame:
    """Evaluate a rule table (message, condition that must hold) per row.

    Output: key, ``ok`` flag and the violated messages joined by '; ' (a
    null condition counts as violated, as a failed coercion would)."""
    msgs = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(m)) for m, cond in rules]))
    return df.select(key, (F.size(msgs) == 0).alias("ok"), F.concat_ws("; ", msgs).alias("errors"))


def split_valid(df: DataFrame, rules: Sequence[tuple[str, F.Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their errors)."""
    msgs = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(m)) for m, cond in rules]))
    tagged = df.withColumn("_errors", msgs)
    return (tagged.where(F.size("_errors") == 0).drop("_errors"),
            tagged.where(F.size("_errors") > 0).withColumn("_errors", F.concat_ws("; ", "_errors")))


def data_quality_score(df: DataFrame, required: Sequence[str], numeric: Sequence[str],
                       dates: Sequence[str], now=None, min_date: str = "2020-01-01") -> DataFrame:
    """Quality checks as a long table (check, passed, n_bad, issue); their
    score is ``quality_score``.

    Checks: all required columns present (one check; ``n_bad`` are the missing
    ones); no exact duplicate rows; per numeric column that is there no
    negatives and no IQR outliers (< Q1 - 1.5 IQR or > Q3 + 1.5 IQR); per date
    column that is there nothing after ``now`` and nothing before ``min_date``.
    The quartiles of all columns are one scalar subquery; all counts but the
    duplicates' come from one aggregation.
    """
    now_c = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    missing = [c for c in required if c not in df.columns]
    numeric, dates = ([c for c in cs if c in df.columns] for cs in (numeric, dates))
    rows = df
    if numeric:
        df = df.withColumn("_q", quantiles_of(df, numeric, (0.25, 0.75)))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in numeric:
        q = F.col("_q")[c]
        iqr = q[1] - q[0]
        aggs += [F.count_if(F.col(c) < 0).alias(f"neg:{c}"),
                 F.count_if((F.col(c) < q[0] - 1.5 * iqr) | (F.col(c) > q[1] + 1.5 * iqr)).alias(f"outlier:{c}")]
    for c in dates:
        aggs += [F.count_if(F.col(c) > now_c).alias(f"future:{c}"),
                 F.count_if(F.col(c) < F.lit(min_date).cast("timestamp_ntz")).alias(f"old:{c}")]
    a = df.agg(*aggs)
    distinct_rows = rows.distinct().agg(F.count(F.lit(1)).alias("_d"))
    dup = a.select((F.col("_rows") - distinct_rows.select("_d").scalar()).alias("duplicates"), *a.columns[1:])
    names = ["duplicates"] + a.columns[1:]
    if required:
        dup, names = dup.withColumn("required", F.lit(len(missing)).cast("long")), ["required", *names]
    kind, col = F.split_part("check", F.lit(":"), F.lit(1)), F.split_part("check", F.lit(":"), F.lit(2))
    n = F.col("n_bad").cast("string")
    issue = (F.when(kind == "required", F.lit(f"Missing required columns: {', '.join(missing)}"))
              .when(kind == "duplicates", F.concat(F.lit("Found "), n, F.lit(" duplicate rows")))
              .when(kind == "neg", F.concat(F.lit("Found "), n, F.lit(" negative values in "), col))
              .when(kind == "outlier", F.concat(F.lit("Found "), n, F.lit(" potential outliers in "), col))
              .when(kind == "future", F.concat(F.lit("Found "), n, F.lit(" future dates in "), col))
              .otherwise(F.concat(F.lit("Found "), n, F.lit(f" dates before {min_date} in "), col)))
    return dup.unpivot([], names, "check", "n_bad").select(
        "check", (F.col("n_bad") == 0).alias("passed"), F.col("n_bad").cast("long").alias("n_bad"),
        F.when(F.col("n_bad") > 0, issue).alias("issue"))


def quality_score(checks: DataFrame) -> DataFrame:
    """Passed / total checks."""
    return checks.agg(r6(F.count_if("passed") / F.count(F.lit(1))).alias("score"),
                      F.count(F.lit(1)).alias("checks"))


def profile_table(df: DataFrame) -> DataFrame:
    """Per column dtype, rows, nulls and, for numeric columns, count,
    mean, std, min, quartiles (exact) and max: one aggregation over the table
    and the quartiles of all columns in one scalar subquery."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if c in num:
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                     F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    a = df.agg(*aggs)
    if num:
        a = a.withColumn("_q", quantiles_of(df, num, (0.25, 0.5, 0.75)))
    dtypes = dict(df.dtypes)
    rows = []
    for c in df.columns:
        st = {s: F.col(f"{c}__{s}") if c in num else F.lit(None).cast("double") for s in ("mean", "std", "min", "max")}
        q = [F.col("_q")[c][i] if c in num else F.lit(None).cast("double") for i in range(3)]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                             F.col("_rows").alias("rows"), F.col(f"{c}__nulls").alias("nulls"),
                             (F.col(f"{c}__count") if c in num else F.lit(None).cast("long")).alias("count"),
                             r6(st["mean"]).alias("mean"), r6(st["std"]).alias("std"), r6(st["min"]).alias("min"),
                             r6(q[0]).alias("q1"), r6(q[1]).alias("median"), r6(q[2]).alias("q3"), r6(st["max"]).alias("max")))
    return a.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max (the
    last bin closed on the right); empty bins included."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    x = F.col(col).cast("double")
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("int"))
    g = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    allb = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = allb.join(g, "bin", "left").fillna(0, subset=["count"])
    return out.select("bin", r6(lo + F.col("bin") * width).alias("bin_start"),
                      r6(lo + (F.col("bin") + 1) * width).alias("bin_end"), "count")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one aggregation,
    long form (col_a, col_b, corr)."""
    cols = list(cols)
    pairs = [(a, b) for a in cols for b in cols]
    a = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"{i}") for i, (x, y) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), r6(F.col(f"{i}")).alias("corr"))
            for i, (x, y) in enumerate(pairs)]
    return a.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def unpivot_scores(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                   name: str = "variable", value: str = "value") -> DataFrame:
    """Wide score columns -> (ids..., variable, value)."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]) \
             .unpivot(list(ids), list(values), name, value)
