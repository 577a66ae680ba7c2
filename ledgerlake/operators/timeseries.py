"""Time analytics and window functions.

Row-level data is reduced by one ``groupBy(period)`` (partial aggregation on
every executor) before any window runs; windows without a partition key only
ever see the per-period table (one row per month/year), never raw rows.
Empty periods come from a calendar spine, as pandas ``resample`` emits them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import (contains_safe, month_start, period_start, pct, r2, r6,
                                          safe_div, xsum)
from ledgerlake.operators.common import fill_spine, period_spine


def _dated(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col(date).isNotNull())


def revenue_over_time(orders: DataFrame, freq: str = "M", date: str = "date",
                      total: str = "total") -> DataFrame:
    """Revenue per period (D/W/M/Q/Y), empty periods = 0."""
    g = _dated(orders, date).groupBy(period_start(date, freq).alias("period")) \
        .agg(xsum(total).alias("revenue"))
    out = fill_spine(g, "period", freq, zero_cols=["revenue"])
    return out.select("period", r2("revenue").alias("revenue"))


def revenue_growth(orders: DataFrame, freq: str = "M", date: str = "date",
                   total: str = "total") -> DataFrame:
    """Period-over-period % change of revenue; null for the first period and
    after a zero period (pandas would give inf)."""
    s = revenue_over_time(orders, freq, date, total)
    w = Window.orderBy("period")
    prev = F.lag("revenue").over(w)
    return s.select("period", "revenue",
                    r6(pct(F.col("revenue") - prev, prev)).alias("growth_pct"))


def customers_over_time(orders: DataFrame, freq: str = "M", date: str = "date",
                        client: str = "client") -> DataFrame:
    """Distinct clients per period, 0-filled."""
    g = _dated(orders, date).groupBy(period_start(date, freq).alias("period")) \
        .agg(F.countDistinct(client).alias("customers"))
    return fill_spine(g, "period", freq, zero_cols=["customers"])


def orders_over_time(orders: DataFrame, date: str = "date", ref: str = "reference") -> DataFrame:
    """T4: count of non-null order references per month, 0-filled."""
    g = _dated(orders, date).groupBy(month_start(date).alias("period")) \
        .agg(F.count(ref).alias("orders"))
    return fill_spine(g, "period", "M", zero_cols=["orders"])


def aov_over_time(orders: DataFrame, date: str = "date", total: str = "total",
                  ref: str = "reference") -> DataFrame:
    """T5: monthly revenue / monthly orders; null when a month has no order."""
    g = _dated(orders, date).groupBy(month_start(date).alias("period")) \
        .agg(xsum(total).alias("revenue"), F.count(ref).alias("orders"))
    s = fill_spine(g, "period", "M", zero_cols=["revenue", "orders"])
    return s.select("period", r6(safe_div("revenue", "orders")).alias("aov"))


def client_months(orders: DataFrame, date: str = "date", client: str = "client") -> DataFrame:
    """Distinct (client, month) pairs with each client's first month.

    Distinct pairs come first, so the per-client window (first month) sees at
    most one row per month for a client however many orders it placed: a hot
    client cannot flood the window task.
    """
    cm = orders.where(F.col(client).isNotNull() & F.col(date).isNotNull()) \
               .select(client, month_start(date).alias("month")).distinct()
    return cm.withColumn("cohort", F.min("month").over(Window.partitionBy(client)))


def cohort_retention(orders: DataFrame, date: str = "date", client: str = "client") -> DataFrame:
    """cohort = month of first order; index = whole months since; distinct
    clients; retention % of the cohort's index-0 size. Long form (unobserved
    cells are absent, as NaN cells of the pivot)."""
    cm = client_months(orders, date, client)
    idx = (F.months_between("month", "cohort")).cast("int")
    g = cm.groupBy("cohort", idx.alias("cohort_index")).agg(F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return g.select("cohort", "cohort_index", "customers",
                    r6(pct("customers", size)).alias("retention_pct"))


def cohort_retention_wide(orders: DataFrame, max_index: int | None = None, **kw) -> DataFrame:
    """T6 pivoted: one column per cohort index 0..max_index; by default up to the
    largest index there is (one number, bounded by the months that the data span)."""
    long = cohort_retention(orders, **kw)
    if max_index is None:
        max_index = long.agg(F.max("cohort_index")).first()[0] or 0
    return long.groupBy("cohort").pivot("cohort_index", list(range(max_index + 1))) \
               .agg(F.first("retention_pct"))


def net_revenue_retention(orders: DataFrame, date: str = "date", client: str = "client",
                          total: str = "total") -> DataFrame:
    """Per cohort (client's first month) and month >= start: cohort revenue
    in the month / cohort revenue in its start month * 100; cohorts with zero
    start revenue are skipped."""
    o = orders.where(F.col(client).isNotNull() & F.col(date).isNotNull())
    per = o.groupBy(client, month_start(date).alias("month")).agg(xsum(total).alias("_rev"))
    per = per.withColumn("cohort", F.min("month").over(Window.partitionBy(client)))
    g = per.groupBy("cohort", "month").agg(F.sum("_rev").alias("revenue"))
    start = F.sum(F.when(F.col("month") == F.col("cohort"), F.col("revenue"))).over(
        Window.partitionBy("cohort"))
    g = g.withColumn("_start", start)
    return g.where((F.col("month") >= F.col("cohort")) & F.col("_start").isNotNull()
                   & (F.col("_start") != 0)).select(
        F.col("cohort").alias("cohort_start"), "month",
        r6(pct("revenue", "_start")).alias("nrr_pct"))


def day_of_week_revenue(orders: DataFrame, date: str = "date", total: str = "total") -> DataFrame:
    """Revenue by English weekday name, largest first."""
    g = _dated(orders, date).groupBy(F.date_format(date, "EEEE").alias("day_of_week")) \
        .agg(xsum(total).alias("revenue"))
    return g.select("day_of_week", r2("revenue").alias("revenue")).orderBy(F.desc("revenue"))


def hour_of_day_revenue(df: DataFrame, date: str = "date", total: str = "total") -> DataFrame:
    """Revenue by hour of day, largest first."""
    g = _dated(df, date).groupBy(F.hour(date).alias("hour")).agg(xsum(total).alias("revenue"))
    return g.select("hour", r2("revenue").alias("revenue")).orderBy(F.desc("revenue"))


def year_over_year(orders: DataFrame, date: str = "date", total: str = "total") -> DataFrame:
    """Per year revenue, orders (all rows), AOV, each with % growth; empty
    years in between are kept with zeros."""
    g = _dated(orders, date).groupBy(period_start(date, "Y").alias("period")).agg(
        xsum(total).alias("total_revenue"), F.count(F.lit(1)).alias("total_orders"))
    s = fill_spine(g, "period", "Y", zero_cols=["total_revenue", "total_orders"])
    s = s.withColumn("yearly_aov", safe_div("total_revenue", "total_orders"))
    w = Window.orderBy("period")
    growth = lambda c: r6(pct(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)))
    return s.select(F.year("period").alias("year"), r2("total_revenue").alias("total_revenue"),
                    growth("total_revenue").alias("revenue_growth"), "total_orders",
                    growth("total_orders").alias("orders_growth"),
                    r6("yearly_aov").alias("yearly_aov"), growth("yearly_aov").alias("aov_growth"))


def monthly_refunds_cancellations(orders: DataFrame, date: str = "date", state: str = "state",
                                  total: str = "total", ref: str = "reference",
                                  refund_states: Sequence[str] = ("O",),
                                  cancel_state: str = "P") -> DataFrame:
    """Monthly count and amount of refunded (any of ``refund_states``,
    full or partial) and of cancelled orders, every month 0-filled."""
    is_ref = F.lit(False)
    for s in refund_states:
        is_ref = is_ref | contains_safe(state, s)
    is_can = contains_safe(state, cancel_state)
    g = _dated(orders, date).groupBy(month_start(date).alias("period")).agg(
        F.count(F.when(is_ref, F.col(ref))).alias("refund_count"),
        F.coalesce(F.sum(F.when(is_ref, F.col(total))), F.lit(0.0)).alias("refund_amount"),
        F.count(F.when(is_can, F.col(ref))).alias("cancel_count"),
        F.coalesce(F.sum(F.when(is_can, F.col(total))), F.lit(0.0)).alias("cancel_amount"))
    s = fill_spine(g, "period", "M", zero_cols=["refund_count", "refund_amount",
                                                "cancel_count", "cancel_amount"])
    return s.select("period", "refund_count", r2("refund_amount").alias("refund_amount"),
                    "cancel_count", r2("cancel_amount").alias("cancel_amount"))


def monthly_top_by(orders: DataFrame, key: str, date: str = "date", total: str = "total",
                   out: str | None = None) -> DataFrame:
    """Per observed month the ``key`` value with the most revenue;
    ties go to the smallest value (pandas ``idxmax`` keeps the first)."""
    g = orders.where(F.col(key).isNotNull() & F.col(date).isNotNull()) \
              .groupBy(month_start(date).alias("period"), key).agg(xsum(total).alias("_rev"))
    w = Window.partitionBy("period").orderBy(F.desc("_rev"), F.asc(key))
    top = g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return top.select("period", F.col(key).alias(out or f"top_{key}"),
                      r2("_rev").alias(f"top_{key}_revenue"))


def monthly_top_payment(orders: DataFrame, **kw) -> DataFrame:
    return monthly_top_by(orders, "payment", **kw)


def monthly_top_country(orders: DataFrame, **kw) -> DataFrame:
    return monthly_top_by(orders, "country", **kw)


def moving_average(series: DataFrame, value: str = "value", period: str = "period",
                   window: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Trailing ``window``-period mean, null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(-(window - 1), 0)
    full = F.count(F.col(value)).over(w) == window
    return series.withColumn(f"{value}_ma{window}", r6(F.when(full, F.avg(value).over(w))))


def linear_trend(series: DataFrame, value: str = "value", period: str = "period",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of value on the 0-based period index."""
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(period)) - 1
    s = series.withColumn("_t", idx.cast("double"))
    g = s.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col("_t")).alias("slope"),
                             F.regr_intercept(F.col(value), F.col("_t")).alias("intercept"),
                             F.count(F.col(value)).alias("points"))
    return g.select(*keys, r6("slope").alias("slope"), r6("intercept").alias("intercept"), "points")


def peak_period(series: DataFrame, value: str = "value", period: str = "period") -> DataFrame:
    """The maximum and its period (earliest on ties)."""
    return series.where(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(period)).limit(1) \
                 .select(period, F.col(value).alias("peak_value"))


def metric_align(*series: DataFrame, col: str = "period") -> DataFrame:
    """Outer-align several per-period series on one calendar spine (the
    spine spans all of them; periods missing from a series stay null)."""
    from functools import reduce
    periods = reduce(lambda a, b: a.unionByName(b), [s.select(col) for s in series])
    out = period_spine(periods, col, "M")
    for s in series:
        out = out.join(s, col, "left")
    return out
