"""Customer analytics.

Row-level orders are first reduced to one row per client by ``groupBy``
(partial aggregation map-side); everything after works on that table.
Global statistics (quartile edges, totals, the as-of date) enter as scalar
subqueries: Spark evaluates them once and inlines the value, so no 1-row
table is joined against the per-client table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.columns import (month_start, pct, quartile_score, r2, r6, rnd,
                                          safe_div, xavg, xsum)
from ledgerlake.functions.quantile import quantile_table, quantiles_of
from ledgerlake.operators.common import ordered_cumsum, settled
from ledgerlake.operators.timeseries import client_months


def _days_between(later, earlier):
    """Whole days elapsed (floor), like ``Timedelta.days`` for later >= earlier."""
    return F.timestamp_diff("DAY", earlier, later)


def _as_of(orders: DataFrame, date: str, as_of=None, plus_days: int = 1):
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    mx = orders.select(F.max(date)).scalar()
    return mx + F.expr(f"INTERVAL {plus_days} DAY") if plus_days else mx


def rfm(orders: DataFrame, client: str = "client", date: str = "date", total: str = "total",
        as_of=None) -> DataFrame:
    """Recency (days from the last order to as-of = max date + 1 day),
    Frequency (orders), Monetary (spend); quartile scores 1-4 (recency
    reversed) and the concatenated RFM score.

    Scores are ``1 + (x>q1) + (x>q2) + (x>q3)`` with linear-interpolated
    quartiles of the per-client table: identical to ``qcut`` labels whenever
    the edges differ, and still defined when they tie.
    """
    asof = _as_of(orders, date, as_of)
    per = orders.where(F.col(client).isNotNull()).groupBy(client).agg(
        F.max(date).alias("_last"), F.count(F.lit(1)).alias("frequency"),
        xsum(total).alias("monetary"))
    per = settled(per.withColumn("recency", _days_between(asof, F.col("_last")).cast("long")).drop("_last"))
    metrics = (("recency", True, "r"), ("frequency", False, "f"), ("monetary", False, "m"))
    # One scalar subquery carries all nine quartile edges.
    out = per.withColumn("_q", quantiles_of(per, [m for m, _, _ in metrics], (0.25, 0.5, 0.75)))
    for m, rev, letter in metrics:
        q = F.col("_q")[m]
        out = out.withColumn(f"{letter}_score", quartile_score(m, q[0], q[1], q[2], reverse=rev))
    return out.select(client, "recency", "frequency", r2("monetary").alias("monetary"),
                      "r_score", "f_score", "m_score",
                      F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                               F.col("m_score").cast("string")).alias("rfm_score"))


def _segment(share):
    s = rnd(share, 9)
    return (F.when((s > 0) & (s <= 20), "High-value")
             .when((s > 20) & (s <= 50), "Mid-value")
             .when((s > 50) & (s <= 100), "Low-value"))


def customer_value_segments(orders: DataFrame, client: str = "client", total: str = "total",
                            partitions: int | None = None) -> DataFrame:
    """Clients by spend (desc, then client id), running share of all
    spend in %; (0,20] High-value, (20,50] Mid-value, (50,100] Low-value.

    The running share is a distributed prefix sum (``ordered_cumsum``): no
    window over the whole client table in a single task. Thresholds are
    compared on the share rounded to 9 digits so summation order cannot flip
    a client at an edge.
    """
    per = orders.where(F.col(client).isNotNull()).groupBy(client).agg(xsum(total).alias("spend"))
    cum = ordered_cumsum(per, [F.col("spend").desc_nulls_last(), F.col(client).asc()],
                         {"_cum": "spend"}, partitions=partitions, grand_totals=True)
    share = pct("_cum", "_cum_grand")
    return cum.select(client, r2("spend").alias("spend"), r6(share).alias("cumsum_pct"),
                      _segment(share).alias("segment"))


def segment_value_box(segments: DataFrame, value: str = "spend") -> DataFrame:
    """Clients and spend quartiles per value segment (box-plot numbers)."""
    segments = settled(segments.select("segment", value))
    q = quantile_table(segments, [value], (0.25, 0.5, 0.75), by=["segment"]).select(F.col("segment").alias("_s"), F.col("q").alias("_q"))
    g = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.min(value).alias("min"), F.max(value).alias("max"))
    g = g.join(q, g["segment"].eqNullSafe(q["_s"]), "left")
    return g.select("segment", "customers", r6("min").alias("min"), r6(F.col("_q")[0]).alias("q1"),
                    r6(F.col("_q")[1]).alias("median"), r6(F.col("_q")[2]).alias("q3"),
                    r6("max").alias("max"))


def clv_profit(lines: DataFrame, client: str = "client", cost: str = "factory_price",
               price: str = "retail", qty: str = "qty", months: int = 12) -> DataFrame:
    """C4: mean line gross profit x mean lines per (non-null) client x months.

    mean(rows per client) = rows with a client / distinct clients, so the
    whole thing is one aggregation.
    """
    profit = (F.col(price) - F.col(cost)) * F.col(qty)
    a = lines.agg(F.avg(profit).alias("_p"), F.count(client).alias("_rows"),
                  F.countDistinct(client).alias("_u"))
    return a.select(r6(F.col("_p") * safe_div("_rows", "_u") * F.lit(months)).alias("clv"))


def clv_revenue(orders: DataFrame, client: str = "client", total: str = "total",
                months: int = 12) -> DataFrame:
    """AOV x mean orders per non-null client x months."""
    a = orders.agg(xavg(total).alias("_aov"), F.count(client).alias("_rows"),
                   F.countDistinct(client).alias("_u"))
    return a.select(r6(F.col("_aov") * safe_div("_rows", "_u") * F.lit(months)).alias("clv"))


def clv_refined(orders: DataFrame, client: str = "client", total: str = "total",
                months: int = 12) -> DataFrame:
    """AOV x (all orders / unique customers) x months."""
    a = orders.agg(xavg(total).alias("_aov"), F.count(F.lit(1)).alias("_n"),
                   F.countDistinct(client).alias("_u"))
    return a.select(r6(F.col("_aov") * safe_div("_n", "_u") * F.lit(months)).alias("clv"))


def _per_client_behavior(orders, client, total, state, cancel_state):
    per = orders.where(F.col(client).isNotNull()).groupBy(client).agg(
        xsum(total).alias("total_revenue"), F.count(F.lit(1)).alias("order_count"),
        F.count_if(F.col(state) == cancel_state).alias("cancelled_orders"))
    return per.withColumn("customer_type",
                          F.when(F.col("order_count") > 1, "repeat").otherwise("one_time"))


def customer_behavior(orders: DataFrame, client: str = "client", total: str = "total",
                      state: str = "state", cancel_state: str = "P") -> DataFrame:
    """Per customer type (repeat if more than one order): customers,
    revenue, orders, cancelled orders, % of customers, % of revenue, and the
    AOV (repeat: revenue / orders; one-time: revenue / customers)."""
    per = _per_client_behavior(orders, client, total, state, cancel_state)
    g = per.groupBy("customer_type").agg(F.count(F.lit(1)).alias("customers"),
                                         F.sum("total_revenue").alias("total_revenue"),
                                         F.sum("order_count").alias("orders"),
                                         F.sum("cancelled_orders").alias("cancelled_orders"))
    allw = Window.partitionBy()
    aov = F.when(F.col("customer_type") == "repeat", safe_div("total_revenue", "orders")) \
           .otherwise(safe_div("total_revenue", "customers"))
    return g.select("customer_type", "customers", r2("total_revenue").alias("total_revenue"),
                    "orders", "cancelled_orders",
                    r6(pct("customers", F.sum("customers").over(allw))).alias("customer_pct"),
                    r6(pct("total_revenue", F.sum("total_revenue").over(allw))).alias("revenue_pct"),
                    r6(aov).alias("avg_order_value"))


def top_repeat_customers(orders: DataFrame, n: int = 10, client: str = "client",
                         total: str = "total", state: str = "state",
                         cancel_state: str = "P") -> DataFrame:
    """C7 (second output): the n repeat customers with the most revenue."""
    per = _per_client_behavior(orders, client, total, state, cancel_state)
    return per.where(F.col("customer_type") == "repeat") \
              .orderBy(F.desc("total_revenue"), F.asc(client)).limit(n) \
              .select(client, r2("total_revenue").alias("total_revenue"), "order_count",
                      "cancelled_orders")


def churn_inactive(orders: DataFrame, inactive_days: int = 90, client: str = "client",
                   date: str = "date", as_of=None) -> DataFrame:
    """% of clients whose last order is more than ``inactive_days`` whole
    days before as-of (max date + 1 day)."""
    asof = _as_of(orders, date, as_of)
    per = orders.where(F.col(client).isNotNull()).groupBy(client).agg(F.max(date).alias("_last"))
    churned = _days_between(asof, F.col("_last")) > inactive_days
    a = per.agg(F.count(F.lit(1)).alias("customers"), F.count_if(churned).alias("churned"))
    return a.select("customers", "churned",
                    r6(F.coalesce(pct("churned", "customers"), F.lit(0.0))).alias("churn_rate"))


def churn_monthly(orders: DataFrame, client: str = "client", date: str = "date",
                  as_percent: bool = True, include_first: bool = False) -> DataFrame:
    """For consecutive observed months m-1 -> m, the share of m-1's clients
    absent in m. ``as_percent`` gives %, else a ratio; ``include_first`` adds
    the first month with a null rate.

    Sets of clients are never collected: distinct (client, month) pairs are
    anti-joined with themselves shifted by one observed month. Observed
    months are numbered on the tiny distinct-month table.
    """
    cm = orders.where(F.col(client).isNotNull() & F.col(date).isNotNull()) \
               .select(client, month_start(date).alias("month")).distinct()
    months = cm.select("month").distinct() \
               .withColumn("ix", F.dense_rank().over(Window.orderBy("month")))
    cmi = cm.join(F.broadcast(months), "month")
    nxt = cmi.select(client, (F.col("ix") - 1).alias("ix"))
    lost = cmi.join(nxt, [client, "ix"], "left_anti").groupBy("ix").agg(F.count(F.lit(1)).alias("_lost"))
    size = cmi.groupBy("ix").agg(F.count(F.lit(1)).alias("_n"))
    prev = size.join(lost, "ix", "left").select((F.col("ix") + 1).alias("ix"), "_n",
                                                 F.coalesce("_lost", F.lit(0)).alias("_lost"))
    scale = 100.0 if as_percent else 1.0
    out = months.join(prev, "ix", "left" if include_first else "inner")
    return out.select("month", r6(safe_div("_lost", "_n") * F.lit(scale)).alias("churn_rate"))


def lifecycle_stages(orders: DataFrame, recency_days: int = 30, frequency_threshold: int = 2,
                     client: str = "client", date: str = "date", ref: str = "reference") -> DataFrame:
    """first/last order, orders, whole days since the last order (to the
    latest date); New (1 order, recent), Active (>= threshold, recent),
    At-Risk otherwise."""
    now = orders.select(F.max(date)).scalar()
    per = orders.where(F.col(client).isNotNull()).groupBy(client).agg(
        F.min(date).alias("first_purchase_date"), F.max(date).alias("last_purchase_date"),
        F.count(ref).alias("total_orders"))
    per = per.withColumn("days_since_last_purchase",
                         _days_between(now, F.col("last_purchase_date")).cast("long"))
    recent = F.col("days_since_last_purchase") <= recency_days
    stage = (F.when((F.col("total_orders") == 1) & recent, "New")
              .when((F.col("total_orders") >= frequency_threshold) & recent, "Active")
              .otherwise("At-Risk"))
    return per.withColumn("stage", stage)


def repeat_purchase_interval(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """C11: mean days between successive orders of the same client, pooled
    over all clients (fixture: A on d1, d3, d5 -> 2.0).

    The successive calendar-day gaps of a client telescope to last - first,
    so the pooled mean is sum(last - first) / sum(orders - 1): a plain
    groupBy, with no per-client sorted window for a hot client to overload.
    """
    per = orders.where(F.col(client).isNotNull() & F.col(date).isNotNull()).groupBy(client).agg(
        F.datediff(F.max(date), F.min(date)).alias("_span"), F.count(F.lit(1)).alias("_n"))
    a = per.agg(F.sum("_span").alias("_s"), F.sum(F.col("_n") - 1).alias("_g"))
    return a.select(r6(safe_div(F.col("_s").cast("double"), "_g")).alias("avg_interval_days"))


def new_vs_returning(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """Per observed month unique, new (first month = month) and returning clients."""
    cm = client_months(orders, date, client)
    g = cm.groupBy("month").agg(F.count(F.lit(1)).alias("unique_customers"),
                                F.count_if(F.col("month") == F.col("cohort")).alias("new_customers"))
    return g.select(F.col("month").alias("period"), "unique_customers", "new_customers",
                    (F.col("unique_customers") - F.col("new_customers")).alias("returning_customers"))


def purchase_frequency(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """Orders (non-null dates) per client."""
    return orders.where(F.col(client).isNotNull()).groupBy(client).agg(F.count(date).alias("orders"))


def purchase_frequency_mean(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """Mean orders per client."""
    return purchase_frequency(orders, client, date).agg(r6(F.avg("orders")).alias("avg_purchase_frequency"))


def customer_acquisition_daily(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """C14 (daily part): distinct clients per observed calendar day."""
    return orders.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("day")) \
                 .agg(F.countDistinct(client).alias("customers"))


def lost_customers(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """(month, client) for every client of the previous observed month
    absent in this one: an anti join of distinct (client, month index)
    pairs with themselves shifted by one observed month."""
    cm = orders.where(F.col(client).isNotNull() & F.col(date).isNotNull()) \
               .select(client, month_start(date).alias("month")).distinct()
    months = cm.select("month").distinct().withColumn("ix", F.dense_rank().over(Window.orderBy("month")))
    cmi = cm.join(F.broadcast(months), "month")
    nxt = cmi.select(client, (F.col("ix") - 1).alias("ix"))
    lost = cmi.join(nxt, [client, "ix"], "left_anti").select(client, (F.col("ix") + 1).alias("ix"))
    return lost.join(F.broadcast(months), "ix").select("month", client)


def first_purchase_join(orders: DataFrame, client: str = "client", date: str = "date") -> DataFrame:
    """Every order with its client's first purchase date. The per-client
    minimum is a partial aggregation; joining it back is a key join that
    AQE's skew handling splits when one client is hot (no window holding a
    client's whole history in one task)."""
    first = orders.where(F.col(client).isNotNull()).groupBy(client).agg(F.min(date).alias("first_purchase"))
    return orders.join(first, client, "left")
