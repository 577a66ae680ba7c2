"""Multi-operator plans: the monthly fact table (T14), the customer report
(C15) and the long KPI table (S5's summary, input of S7/X5/X7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.columns import month_start, r2, r6, safe_div
from ledgerlake.operators import basic as B
from ledgerlake.operators import customers as C
from ledgerlake.operators import timeseries as TS
from ledgerlake.operators.common import kpi_long, period_spine
from ledgerlake.sources import tables as tb


def monthly_metrics(orders: DataFrame, country_orders: DataFrame | None = None, refund_states=("O",),
                    cancel_state: str = "P") -> DataFrame:
    """One row per calendar month (spine from first to last month):
    revenue, orders, unique customers, AOV, new and returning customers,
    churn rate (% of the previous observed month's clients lost), refund and
    cancellation counts and amounts, top payment method and top country.

    ``country_orders`` (orders with ``country``; defaults to ``orders``) feeds
    only the top-country branch, so the customer join runs once. Every
    branch is reduced to one row per month (or per month x key) before the
    branches are joined on the month.
    """
    o = orders.where(F.col("date").isNotNull())
    is_ref = F.lit(False)
    for s in refund_states:
        is_ref = is_ref | F.coalesce(F.contains("state", F.lit(s)), F.lit(False))
    is_can = F.coalesce(F.contains("state", F.lit(cancel_state)), F.lit(False))
    base = o.groupBy(month_start("date").alias("period")).agg(
        F.sum("total").alias("revenue"), F.count("reference").alias("orders"),
        F.count(F.when(is_ref, F.col("reference"))).alias("refund_count"),
        F.sum(F.when(is_ref, F.col("total"))).alias("refund_amount"),
        F.count(F.when(is_can, F.col("reference"))).alias("cancel_count"),
        F.sum(F.when(is_can, F.col("total"))).alias("cancel_amount"))
    spine = period_spine(base, "period", "M")
    nr = C.new_vs_returning(orders).select("period", "unique_customers", "new_customers",
                                           "returning_customers")
    churn = C.churn_monthly(orders).select(F.col("month").alias("period"), "churn_rate")
    pay = TS.monthly_top_payment(orders).select("period", "top_payment")
    ctry = TS.monthly_top_country(country_orders if country_orders is not None else orders) \
             .select("period", "top_country")
    m = spine.join(base, "period", "left").join(nr, "period", "left").join(churn, "period", "left") \
             .join(pay, "period", "left").join(ctry, "period", "left")
    zero = ["revenue", "orders", "unique_customers", "refund_count", "refund_amount", "cancel_count",
            "cancel_amount", "new_customers", "returning_customers"]
    for c in zero:
        m = m.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(m.schema[c].dataType)))
    return m.select("period", r2("revenue").alias("revenue"), "orders", "unique_customers",
                    r6(safe_div("revenue", "orders")).alias("aov"), "new_customers", "returning_customers",
                    "churn_rate", "refund_count", r2("refund_amount").alias("refund_amount"),
                    "cancel_count", r2("cancel_amount").alias("cancel_amount"), "top_payment", "top_country")


def kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (metric, value) table of the one-row KPIs (the summary file)."""
    o = tb.orders(spark, sf_dir)
    parts = [B.basic_kpis(o), B.average_order_value(o), B.order_value_distribution(o),
             C.clv_revenue(o), C.churn_inactive(o).select("churn_rate"),
             B.refund_cancellation(o),
             B.cart_abandonment_rate(tb.carts(spark, sf_dir), o).select("abandonment_rate")]
    out = None
    for p in parts:
        long = kpi_long(p)
        out = long if out is None else out.unionByName(long)
    return out


def customer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly acquisition, geographic distribution, CLV and mean
    purchase frequency as one long (section, key, value) table."""
    o = tb.orders(spark, sf_dir)
    acq = TS.customers_over_time(o).select(F.lit("monthly_acquisition").alias("section"),
                                           F.col("period").cast("string").alias("key"),
                                           F.col("customers").cast("double").alias("value"))
    geo = B.geographic_distribution(tb.orders(spark, sf_dir, with_country=True)).select(
        F.lit("geographic_distribution").alias("section"), F.col("country").alias("key"),
        F.col("order_count").cast("double").alias("value"))
    clv = C.clv_revenue(o).select(F.lit("clv").alias("section"), F.lit("clv").alias("key"),
                                  F.col("clv").alias("value"))
    pf = C.purchase_frequency_mean(o).select(F.lit("purchase_frequency").alias("section"),
                                             F.lit("avg_purchase_frequency").alias("key"),
                                             F.col("avg_purchase_frequency").alias("value"))
    return acq.unionByName(geo).unionByName(clv).unionByName(pf)
